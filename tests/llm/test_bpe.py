"""BPE against the tokenizers library, and the transducer against plain dictionaries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_frames import docs  # noqa: F401

from callboard.llm import bpe, queries, transducer

TINY = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a  b", " a", "a ", "\n a", "a \n b", "a \n\n  b", "x\t y", "don't I'LL we'll 's", "<|endoftext|>", " <|endoftext|> x",
       "<|endoftext|><|endoftext|>", "日本語 です", "a" * 5000, "ab" * 3000 + " " + "é" * 700, " x　y", "½ ² x²", "🤣👨‍👩‍👧", "\x00\x1c\x1f a", "12345 89", "\r\n x\r\n"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(PATH)


def test_ids_and_text_equal_the_library_with_and_without_a_lexicon(library, vocabulary, tmp_path):
    rnd = random.Random(1)
    letters = list(" \n\t'sadre.,!09éß日<|endoftext|> ")
    texts = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(2000)]
    wanted = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    words = sorted({w for t in texts for w in t.split(" ")[1:] if w and len(w.encode()) <= 64})
    path = tmp_path / "lexicon.bin"
    path.write_bytes(bpe.pack(bpe.lexicon(vocabulary, words)))
    for coder in (bpe.Coder(vocabulary), bpe.Coder(bpe.mapped(str(path)))):
        got = list(coder.encode([*texts, None]))
        assert [g.tolist() for g in got] == [*wanted, []]
        assert [coder.decode(g) for g in got[:-1]] == [library.decode(w, skip_special_tokens=False) for w in wanted]
    assert bpe.Coder(vocabulary).decode(np.array([187], "<u4")) == library.decode([187])  # half a character


def test_the_transducer_is_minimal_and_numbers_words():
    words = sorted({b"tap", b"taps", b"top", b"tops", b"stop", b"stops", b""})
    made = transducer.compile_words(words)
    assert transducer.ranks(made, [*words, b"to", b"topsy", b"x"]).tolist() == [*range(len(words)), -1, -1, -1]
    futures = {frozenset(w[len(p):] for w in words if w.startswith(p)) for w in words for p in [w[:i] for i in range(len(w) + 1)]}
    assert len(made["final"]) == len(futures)
    assert transducer.ranks(transducer.compile_words([]), [b"a"]).tolist() == [-1]


def test_the_query_equals_the_library(spark, library):
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_transducer_bpe"](spark, TINY).collect()}
    for row in spark.read.parquet(f"{TINY}/documents.parquet").collect():
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert (len(ids), digest, hashlib.sha256(text.encode()).hexdigest()) == (
            got[row["doc_id"]]["n_tokens"], got[row["doc_id"]]["ids_sha256"], got[row["doc_id"]]["decoded_sha256"])


def test_nulls_repeats_empty_tables_and_other_columns(spark, docs):
    frame = docs([(1, None), (2, ""), (3, "a b a b"), (3, "a b a b"), (None, "x")]).withColumn("ids", F.lit("other"))
    name = bpe.publish(frame, "text", PATH)
    coded = bpe.encode(frame, name, columns=["doc_id", "found"])
    back = bpe.decode(coded, name).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["found"], r["decoded"]) for r in back] == [(None, "y", "x"), (1, "y", ""), (2, "y", ""), (3, "y", "a b a b"), (3, "y", "a b a b")]
    empty = frame.limit(0)
    assert bpe.encode(empty, bpe.publish(empty, "text", PATH), columns=["doc_id"]).count() == 0


def test_one_pass_encodes_and_decodes(spark, docs):
    frame = docs([(3, "a b a b"), (1, None), (2, ""), (None, "x <|endoftext|>  é\U0001f600")])
    both = queries.encoded(frame, "doc_id")
    assert both._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    name = bpe.publish(frame, "text", public_tokenizers.path("byte_bpe_50k.json"))
    apart = bpe.decode(bpe.encode(frame, name, columns=["doc_id"]), name).orderBy("doc_id").collect()
    once = bpe.encode(frame, name, columns=["doc_id"], decoded="back").orderBy("doc_id").collect()
    assert [(r["doc_id"], r["back"]) for r in once] == [(r["doc_id"], r["decoded"]) for r in apart]
    assert bpe.decode(both.select("doc_id", "ids"), name).where("decoded <> ''").count() == 2
