"""Tables whose own columns bear the names that operators use inside: values stay, nothing breaks."""

import pytest
from pyspark.sql import functions as F

from callboard.llm import alignment, bpe, decontam, langid, linededup, merkle, pii, queries, secretscan, sharding, simhash, tagpath

#: Names that operators use inside, or once used.
INSIDE = [
    "_text_", "_new_", "_drop", "_stay", "_slot_", "_shard_", "_page_", "_digest_", "_found_", "_lang_", "_score_", "_site", "_line",
    "_k0", "_k1", "_h", "_n", "_pages", "_gone", "text_", "new_", "drop_", "stay_", "slot_", "shard_", "page_", "digest_", "found_",
    "lang_", "score_", "fp", "id", "component_id", "root", "node", "least", "block", "row", "g", "pos", "run", "digest", "given", "part",
    "place", "head", "assign", "hex", "access", "entropy_hex", "pair", "links", "lead", "answers", "html_", "words", "item", "window",
]
VOCABULARY = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
BYTE, PIECE = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def table(spark):
    texts = ["call t@b.com now", "Menu\\nown line of text", "Menu\\nother", "token = abcdefgh12345678", None, "", "plain words of the text here"] * 3
    rows = [(k, t, "s", "en" if k % 2 else "fr", 10, *[f"{c}-{k}" for c in INSIDE]) for k, t in enumerate(texts)]
    kinds = "doc_id bigint, text string, source string, lang string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in INSIDE)
    return spark.createDataFrame(rows, kinds).cache()


def bench(spark):
    return spark.createDataFrame([(1, "quite some other words")], "item_id bigint, text string")


OPERATORS = {
    "linededup": lambda s, d: linededup.without_boilerplate(d, n_lines="n_lines", n_dropped="n_dropped"),
    "sharding": lambda s, d: sharding.place(d, ["doc_id"], ["a", "b"]),
    "pii": lambda s, d: pii.replace(d, "k", kinds="kinds", found="n_found"),
    "secretscan": lambda s, d: secretscan.find(d, found="spans"),
    "simhash": lambda s, d: simhash.keep_one(d),
    "decontam": lambda s, d: decontam.clean(d, bench(s)),
    "decontam found": lambda s, d: decontam.occurrences(d, decontam.publish(bench(s)), found="contamination"),
    "langid": lambda s, d: langid.keep_identified(d, VOCABULARY),
    "tagpath": lambda s, d: tagpath.extract(d.withColumn("html", F.col("text"))),
    "bpe": lambda s, d: bpe.encode(d, bpe.publish(d, "text", BYTE), ids="token_ids", columns=[c for c in d.columns if c != "text"]),
    "alignment": lambda s, d: alignment.aligned(d, BYTE, PIECE, columns=[c for c in d.columns if c != "text"]),
    "merkle": lambda s, d: merkle.build(d, ["doc_id", "text"], "source", ["doc_id"], keep=d.columns).verify(),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_columns_of_these_names_keep_their_values(spark, table, name):
    got = OPERATORS[name](spark, table)
    results = {"root"} if name == "merkle" else set()
    kept = [c for c in INSIDE if c not in results]
    assert set(kept) <= set(got.columns)
    rows = got.select("doc_id", *kept).collect()
    assert rows and all(r[c] == f"{c}-{r['doc_id']}" for r in rows for c in kept)
