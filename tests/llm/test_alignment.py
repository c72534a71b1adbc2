"""Alignment of two tokenizers against cuts and overlaps found one by one with their libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from callboard.llm import alignment, bpe, queries

TINY = "/root/testdata/sf0.001"
A, B = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts, libraries):
    a, b = libraries
    chars, names = bpe._byte_of_char(), {i: p for p, i in a.get_vocab().items()}
    piece = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    token_a = lambda i: bytes(chars[c] for c in names[i])
    token_b = lambda i: bytes([int(piece[i][3:5], 16)]) if b.is_byte(i) else piece[i].replace("▁", " ").encode()

    def spans(ids, token):
        at, out = 0, []
        for i in ids:
            out.append((at, at := at + len(token(i)), i))
        return out

    found, total = [], Counter()
    for text in texts:
        sa = spans(a.encode(" " + text, add_special_tokens=False).ids, token_a) if text else []
        sb = spans(b.encode(text), token_b) if text else []
        whole = (" " + (text or "")).encode()
        if b"".join(token_a(x[2]) for x in sa) != whole or b"".join(token_b(x[2]) for x in sb) != whole:
            sa = sb = []
        cuts = sorted({x[1] for x in sa} & {x[1] for x in sb})
        groups = []
        for low, high in zip([0, *cuts], cuts):
            inside = [",".join(str(i) for s, e, i in side if low <= s and e <= high) for side in (sa, sb)]
            groups.append("|".join(inside))
        links, j = [], 0
        for s, e, i in sa:
            while sb[j][1] <= s:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < e:
                links.append((i, sb[k][2]))
                k += 1
        total.update(links)
        found.append((len(sa), len(sb), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = {}
    for (_, j), n in total.items():
        most[j] = max(most.get(j, 0), n)
    return [(na, nb, g, len(ls), sum(total[x] == most[x[1]] for x in ls), sum(total[x] for x in ls), h) for na, nb, g, ls, h in found]


def run(spark, texts, **names):
    rows = [(i, t, 5, "x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, block int, n_a string").repartition(3)
    got = alignment.aligned(frame, A, B, columns=["doc_id", "block", "n_a"]).orderBy("doc_id").collect()
    assert all(r["block"] == 5 for r in got) and [r["doc_id"] for r in got] == list(range(len(texts)))
    return [tuple(r[c] for c in alignment.RESULTS) for r in got]


ODD = [
    None, "", " ", "  a  b", "\n\n \t x", "▁x", "a▁b", "<|endoftext|>", "x<|endoftext|>y", "<s> x </s>", "<unk>", "<0x41>",
    "😀é日本語ﬁ", "don't I'LL we've", "\x00\x01\x7f", "1234567 12 3", "x\r\ny", "a", "a", "the the the", "a" * 20_000,
]


def test_odd_texts(spark, libraries):
    rng = random.Random(2)
    ranges = [(32, 1000), (0x3000, 0x9FFF), (0x1F300, 0x1F6FF)]
    mixed = ["".join(chr(rng.randint(*rng.choice(ranges))) for _ in range(n)) for n in (1, 7, 50, 3000)]
    texts = ODD + mixed
    assert run(spark, texts) == brute(texts, libraries)
    assert alignment.aligned(spark.createDataFrame([], "doc_id int, text string"), A, B, columns=["doc_id"]).count() == 0


def test_whole_table_in_small_blocks(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(alignment, "PAIRS_A_ROW", 100)
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{TINY}/documents.parquet").collect())
    found = {r["doc_id"]: tuple(r[c] for c in alignment.RESULTS) for r in queries.QUERIES["op11_interval_alignment"](spark, TINY).collect()}
    assert [found[i] for i, _ in rows] == brute([t for _, t in rows], libraries) and len(found) == len(rows)


def test_code_points_cut_alike(libraries):
    """The byte side equals the tokenizers library on every code point."""
    side = alignment.ByteSide(A)
    texts = ["".join(chr(c) + " " * (c % 2) for c in range(k, k + 256) if not 0xD800 <= c < 0xE000) for k in range(0, 0x20000, 256)]
    wanted = [e.ids for e in libraries[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert [ids.tolist() for ids in side.encode(texts)] == wanted


def test_groups_and_overlaps_of_drawn_tilings():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        ends = [np.unique(np.r_[rng.integers(1, n + 1, int(rng.integers(0, n + 1))), n]) for _ in range(2)]
        group_a, group_b, groups = alignment.coalesced(*ends)
        cuts = np.intersect1d(*ends)
        assert groups == len(cuts)
        assert (group_a == np.searchsorted(cuts, ends[0])).all() and (group_b == np.searchsorted(cuts, ends[1])).all()
        spans = [[(0 if i == 0 else e[i - 1], e[i]) for i in range(len(e))] for e in ends]
        pairs = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
        assert list(zip(*(x.tolist() for x in alignment.overlaps(*ends)))) == pairs
        assert len(pairs) == len(ends[0]) + len(ends[1]) - groups
