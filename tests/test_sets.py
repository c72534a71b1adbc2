"""Procedures from SQL, reports over shared tables, mergeable counts, collated keys."""

import inspect

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from callboard.operators import aggregates as A
from callboard.operators import joins as J
from callboard.operators import quality as Q
from callboard.plans import batch, views
from callboard.plans import bindings as B
from callboard.plans import reports as R
from callboard.plans.catalog import QUERIES
from callboard.plans.queries_sets import MONEY_REPORTS, NOCASE
from callboard.plans.registry import Data


@pytest.mark.parametrize("name", sorted(views.PROCEDURES))
def test_procedures_from_sql_equal_the_reports(spark, seed, name):
    views.register_procedures(spark, seed, [name], "seed_")
    report, key = views.PROCEDURES[name], views.KEYS[name]
    if key is None:
        assert rows(spark.sql(f"SELECT * FROM seed_{name}()")) == rows(report(seed))
        return
    parameter = "film_id" if "film_id" in inspect.signature(report).parameters else "key"
    for k in (1, 4, 99):
        assert rows(spark.sql(f"SELECT * FROM seed_{name}({k})")) == rows(report(seed, **{parameter: k}))
    keys = spark.createDataFrame([(1,), (4,), (99,), (None,), (4,)], "k int")
    found = spark.sql(f"SELECT r.* FROM {{keys}} x, LATERAL seed_{name}(x.k) r", keys=keys)
    assert found.count() == sum(report(seed, **{parameter: k}).count() for k in (1, 4, 4))


def test_a_constant_argument_reaches_the_scan(spark):
    d = Data(spark, SMALL)
    tables = {"role": B.line_role(d), "film": B.film_plain(d), "director": B.director(d)}
    views.register_procedures(spark, tables, ["sp_get_actor_filmography"], "scan_")
    plan = spark.sql("SELECT * FROM scan_sp_get_actor_filmography(7)")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_partkey,7)" in plan


def test_a_batch_of_reports_scans_the_lines_once(spark):
    d = Data(spark, SMALL)
    tables = {"film": B.film(d), "director": B.director(d), "role": B.line_role(d)}
    assert set(batch.readers(tables, MONEY_REPORTS)["film"]) == set(MONEY_REPORTS)
    assert batch.is_derived(tables["film"]) and not batch.is_derived(tables["director"])
    found = batch.run(tables, MONEY_REPORTS)
    for name, report in MONEY_REPORTS.items():
        assert rows(found[name]) == rows(report(tables)), name
        plan = found[name]._jdf.queryExecution().executedPlan().toString()
        assert "l_extendedprice" not in plan and "shared-film" in plan
    # Read by one report only: nothing is written for it.
    alone = batch.run(tables, {"film_listing": R.film_listing})["film_listing"]
    assert "shared-film" not in alone._jdf.queryExecution().executedPlan().toString()


def test_sketches_of_parts_add_up(spark):
    data = [(k, m, p) for k in ("a", "b", None) for m in (-40_000, -1, 0, 1, 32_767, 32_768, 2**40, None) for p in (1, 2)]
    data += [("a", 7, 1), ("a", 8, 2), ("c", None, 1)]
    frame = spark.createDataFrame(data, "k string, m bigint, p int")
    want = rows(frame.where("m IS NOT NULL").groupBy("k").agg(F.count_distinct("m").alias("n")))
    assert rows(A.sketched_counts(A.distinct_sketch(frame, ["k"], "m"), ["k"], "n")) == want
    parts = [A.distinct_sketch(frame.where(F.col("p") == p), ["k"], "m") for p in (1, 2)]
    assert rows(A.sketched_counts(A.united_sketches(parts[0].unionByName(parts[1]), ["k"]), ["k"], "n")) == want
    assert A.distinct_sketch(frame.limit(0), ["k"], "m").count() == 0


def test_a_hot_key_sends_bitmaps_and_no_ids(spark):
    hot = spark.range(400_000, numPartitions=4).selectExpr("1 AS film_id", "id % 50000 AS actor_id")
    sketch = A.distinct_sketch(hot, ["film_id"], "actor_id")
    assert rows(A.sketched_counts(sketch, ["film_id"], "n")) == [(1, 50_000)]
    plan = sketch._jdf.queryExecution().executedPlan().toString()
    before_exchange = plan[plan.index("Exchange") :]
    assert "partial_bitmap_construct_agg" in before_exchange and plan.count("Exchange hashpartitioning") == 1
    assert sketch.count() == 3  # 1..32768 and beyond, and zero in a bucket of its own


def test_words_count_distinct_members(spark):
    data = [(k, m) for k in ("a", "b", None) for m in (-(2**63), -40_000, -64, -1, 0, 1, 63, 63, 64, 2**40, 2**63 - 1, None)]
    frame = spark.createDataFrame([*data, ("a", 7), ("c", None)], "k string, m bigint")
    want = rows(frame.where("m IS NOT NULL").groupBy("k").agg(F.count_distinct("m").alias("n")))
    assert rows(A.word_counts(A.distinct_words(frame, ["k"], "m"), ["k"], "n")) == want
    small = frame.where("m BETWEEN -100 AND 100").withColumn("m", F.col("m").cast("int"))
    assert rows(A.word_counts(A.distinct_words(small, ["k"], "m"), ["k"], "n")) == rows(small.groupBy("k").agg(F.count_distinct("m").alias("n")).where("n > 0"))
    hot = spark.range(400_000, numPartitions=4).selectExpr("1 AS film_id", "id % 64000 AS actor_id")
    assert A.distinct_words(hot, ["film_id"], "actor_id").count() == 1000


def test_bitmap_reports_hold_no_wide_bitmap_per_key(spark):
    """A film or scene with a few rows must not cost 4 KB a member, and its aggregate stays a hash aggregate."""
    for name in ("production_summary_bitmaps", "scene_filming_summary_bitmaps"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "bit_or" in plan and "bitmap_construct_agg" not in plan, name
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan, name


def test_spread_joins_under_a_collation(spark):
    text = lambda c: F.collate(c, NOCASE)
    left = spark.createDataFrame([("Ab", 1), ("aB", 2), ("x", 3), (None, 4), ("STRASSE", 5)], "k string, n int")
    right = spark.createDataFrame([("AB",), ("strasse",), (None,)], "k string").select(text("k").alias("k"))
    left = left.select(text("k").alias("k"), "n")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how, want in (("left_semi", [1, 2, 5]), ("left_anti", [3, 4]), ("inner", [1, 2, 5]), ("left", [1, 2, 3, 4, 5])):
            found = J.join_on(left, right, {"k": "k"}, how, spread=True)
            assert sorted(r["n"] for r in found.collect()) == want, how
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    with pytest.raises(ValueError):
        J.join_on(left, right.select(F.collate("k", "UNICODE_CI").alias("k")), {"k": "k"}, "inner", spread=True)
    assert [r["n"] for r in Q.duplicate_keys(left, ["k"], "n").collect()] == [2]
