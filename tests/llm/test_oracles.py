"""Registered queries against their SQL, and the pipeline against a plain composition of its rules."""

import os
import re

import compare
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from callboard.llm import queries
from test_decontam import brute as contamination
from test_simhash import brute as near_copies

TINY = "/root/testdata/sf0.001"
ORACLE_FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def db():
    return compare.connect(ORACLE_FOLDER)


def test_all_operators_and_the_pipeline_are_registered():
    names = set(contract.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= names and set(queries.ORACLE) <= set(contract.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "bpe_tokens"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_reference_sql(spark, db, name):
    assert compare.difference(queries.QUERIES[name](spark, ORACLE_FOLDER), db, queries.ORACLE[name]) is None


def plain_lines(rows):
    """Line dedup by the rule itself: rows are (id, text, source)."""
    pages, lines = {}, {}
    for _, text, source in rows:
        pages[source] = pages.get(source, 0) + 1
        for line in {x.strip(" ") for x in text.split("\n")} - {""}:
            lines[source, line] = lines.get((source, line), 0) + 1
    gone = {k for k, n in lines.items() if n >= 5 and n > 0.1 * pages[k[0]]}
    return [(i, "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in gone), s) for i, t, s in rows]


def test_pipeline_equals_a_plain_composition(spark):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
    rows = plain_lines([r for r in docs if r[1] and re.search(r"[^\W\d_]", r[1])])
    _, parts = near_copies([(i, t) for i, t, _ in rows])
    rows = [r for r, c in zip(rows, parts) if r[0] == c]
    judged = [(r, contamination(r[1], items)) for r in rows]
    rows = [r for r, (n, hit, _) in judged if not (hit > 0 and 20 * hit >= n)]
    library = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    wanted = {i: library.encode(t, add_special_tokens=False).ids for i, t, _ in rows}
    got = corpus_pipeline.run(spark, TINY).collect()
    assert {r["doc_id"]: list(memoryview(bytes(r["ids"])).cast("I")) for r in got} == wanted
    assert all(r["n_tokens"] == len(wanted[r["doc_id"]]) for r in got) and len(got) == len(wanted)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, TINY).columns == docs.columns, name
        assert stage(spark, docs.limit(0), TINY).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), TINY).count() == 0
