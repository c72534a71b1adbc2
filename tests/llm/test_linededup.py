"""Line dedup on small sites; the whole table goes against SQL."""

import re

from llm_frames import docs  # noqa: F401

from callboard.llm import linededup, queries

TINY = "/root/testdata/sf0.001"


def test_site_ratios_decide(spark, docs):
    rows = [(i, f"Menu \nown {i}\n\nMenu", "a") for i in range(10)] + [(100 + i, "Menu\nrest", f"site{i}") for i in range(4)]
    rows += [(200, "Menu\nx", None), (201, None, "a"), (202, "", "a"), (203, "Menu", "a"), (203, "Menu", "a"), (None, " Menu", "a")]
    frame = docs(rows).withColumnRenamed("id", "_site").withColumnRenamed("found", "n_lines")
    got = linededup.without_boilerplate(frame, n_lines="n_lines", n_dropped="n_dropped")
    assert got.columns == ["doc_id", "text", "source", "n", "_site", "n_lines", "n_dropped"]
    found = {(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()}
    assert found == {(i, f"own {i}\n", 4, 2) for i in range(10)} | {(100 + i, "Menu\nrest", 2, 0) for i in range(4)} | {
        (200, "Menu\nx", 2, 0), (201, None, 0, 0), (202, "", 1, 0), (203, "", 1, 1), (None, "", 1, 1)}
    assert got.count() == len(rows)
    assert linededup.without_boilerplate(docs([])).count() == 0


def test_a_line_on_few_pages_or_a_small_share_stays(spark, docs):
    rows = [(i, f"line {i}" + ("\nsome" if i < 5 else ""), "a") for i in range(60)]
    assert all("some" in r["text"] for r in linededup.without_boilerplate(docs(rows)).where("doc_id < 5").collect())
    assert all("some" not in r["text"] for r in linededup.without_boilerplate(docs(rows), ratio=0.05).where("doc_id < 5").collect())
    assert all("some" in r["text"] for r in linededup.without_boilerplate(docs(rows), ratio=0.05, least=6).where("doc_id < 5").collect())


def test_native_plan(spark):
    plan = queries.QUERIES["op10_site_relative_line_dedup"](spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
