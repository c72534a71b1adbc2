"""A third of all rows on one key: right results, and AQE splits the hot partition."""

from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from callboard.operators import changes as C
from callboard.operators import joins as J
from callboard.operators import lookups as L
from callboard.operators import quality as Q
from callboard.sources.model import Ref

SMALL_LIMITS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20kb",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10kb",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1kb",
}

ROWS, KEYS, HOT = 60_000, 500, 7


@pytest.fixture
def limits(spark):
    for name, value in SMALL_LIMITS.items():
        spark.conf.set(name, value)
    yield
    for name in SMALL_LIMITS:
        spark.conf.unset(name)


@pytest.fixture
def fact(spark):
    """Rows spread over many map tasks, a third of them on one key, some on no known key."""
    key = F.when(F.col("id") % 3 == 0, HOT).otherwise((F.xxhash64("id") % KEYS + KEYS) % KEYS + F.col("id") % 2 * 10)
    base = spark.range(ROWS, numPartitions=16)
    return base.select("id", key.cast("int").alias("k"), F.sha1(F.col("id").cast("string")).alias("pad"))


@pytest.fixture
def dim(spark):
    return spark.range(0, KEYS, numPartitions=4).select(
        F.col("id").cast("int").alias("d"), F.concat(F.lit("n"), "id").alias("name")
    )


def split_and_collected(df):
    got = df.collect()
    return got, "skew" in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_lookup_splits_the_hot_key(limits, fact, dim):
    got, split = split_and_collected(J.lookup(fact, dim, {"k": "d"}, ["name"]))
    assert len(got) == ROWS and split
    assert all(r.name == (f"n{r.k}" if r.k < KEYS else None) for r in got)


def test_semi_and_anti_joins_split_the_hot_key(limits, fact, dim):
    some = dim.where("d < 400")
    inside, split_in = split_and_collected(J.having_match(fact, some, {"k": "d"}))
    outside, split_out = split_and_collected(J.without_match(fact, some, {"k": "d"}))
    assert split_in and len(inside) + len(outside) == ROWS
    assert all(r.k < 400 for r in inside) and all(r.k >= 400 for r in outside)


def test_details_of_a_hot_parent_are_split(limits, fact, dim):
    got, split = split_and_collected(J.details_with_count(dim, fact, {"d": "k"}, ["id", "pad"], "n"))
    counts = Counter(r.d for r in got if r.id is not None)
    assert split and all(r.n == max(counts[r.d], 1) for r in got)
    assert sum(counts.values()) == fact.where(F.col("k") < KEYS).count()


def test_reference_rule_splits_the_hot_key(limits, fact, dim):
    rule = Q.Reference("fk", "m", ("k",), "dim", ("d",))
    got, split = split_and_collected(Q.check(fact, [rule], {"dim": dim}))
    assert split and len(got) == ROWS and all(r.is_valid == (r.k < KEYS) for r in got)


def test_cascade_from_a_hot_parent(limits, fact, dim):
    refs = [("fact", Ref("k", "dim", "d"))]
    gone = dim.where(F.col("d") == HOT).select("d")
    left = C.delete_cascade({"dim": dim, "fact": fact}, "dim", gone, refs)
    assert left["dim"].count() == KEYS - 1
    kept, split = split_and_collected(left["fact"])
    assert split and len(kept) == fact.where(F.col("k") != HOT).count()


def test_cleared_references_split_the_hot_key(limits, fact, dim):
    refs = [("fact", Ref("k", "dim", "d", "set null"))]
    gone = dim.where(F.col("d") == HOT).select("d")
    got, split = split_and_collected(C.delete_cascade({"dim": dim, "fact": fact}, "dim", gone, refs)["fact"])
    assert split and len(got) == ROWS and sum(r.k is None for r in got) == fact.where(F.col("k") == HOT).count()


def test_lookup_of_an_aggregate_splits_the_hot_key(limits, fact, dim):
    """The aggregate is partitioned by the same key; without ``spread`` nothing is split."""
    got, split = split_and_collected(L.child_count(fact, dim, {"k": "d"}, "n"))
    assert split and len(got) == ROWS and all(r.n == (r.k < KEYS) for r in got)
    got, split = split_and_collected(J.attach(fact, dim, {"k": "d"}, {"n": F.count(F.lit(1))}))
    assert not split and len(got) == ROWS


def test_key_rule_splits_a_hot_duplicate(limits, fact):
    got, split = split_and_collected(Q.check(fact, [Q.Unique("uq", "m", ("k",))]))
    counts = Counter(r.k for r in got)
    assert split and all(r.is_valid == (counts[r.k] == 1) for r in got)


def test_spread_joins_agree_across_key_types(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (2**31 - 1, "c")], "k int, s string")
    right = spark.createDataFrame([(1,), (2**31 - 1,), (2**40,)], "r bigint")
    for how in ("left_semi", "left_anti", "inner", "left"):
        plain = J.join_on(left, right, {"k": "r"}, how)
        assert rows(J.join_on(left, right, {"k": "r"}, how, spread=True)) == rows(plain)
    text = spark.createDataFrame([("1",)], "r string")
    assert rows(J.join_on(left, text, {"k": "r"}, "inner", spread=True)) == [(1, "a")]
    money = spark.sql("SELECT CAST(1 AS DECIMAL(5,2)) AS r UNION ALL SELECT CAST(2.5 AS DECIMAL(5,2))")
    assert rows(J.join_on(left, money, {"k": "r"}, "inner", spread=True)) == [(1, "a")]
    zero, minus = (spark.sql(f"SELECT CAST({x} AS DOUBLE) AS r") for x in ("0.0", "-0.0"))
    assert J.join_on(zero, minus, {"r": "r"}, "inner", spread=True).count() == 1
    # Types without a common hash are refused, so a hot key is never left whole unseen.
    with pytest.raises(ValueError):
        J.join_on(left, spark.sql("SELECT DATE'2024-01-01' AS r"), {"k": "r"}, "inner", spread=True)


def test_log_audit_spreads_a_hot_key_over_tasks(spark, fact):
    """No task of the range shuffle holds much more than its share, though one key has a third."""
    spread = fact.repartitionByRange(8, "k", "id")
    sizes = [r[0] for r in spread.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 8 and max(sizes) < ROWS / 8 * 1.6


def test_counts_per_hot_key_combine_before_the_shuffle(limits, fact):
    per_key = J.per_parent(fact, "k", {"n": F.count(F.lit(1)), "members": F.count_distinct("pad")})
    expected = Counter(r.k for r in fact.select("k").collect())
    assert rows(per_key) == sorted([(k, n, n) for k, n in expected.items()], key=repr)
    assert "partial_count" in per_key._jdf.queryExecution().toString()


def test_hot_collated_key_is_split(spark, limits):
    word = "CASE WHEN id % 3 = 0 THEN if(id % 2 = 0, 'Hot', 'hOT') ELSE concat('key', id % 500) END"
    left = spark.range(ROWS, numPartitions=16).selectExpr(f"collate({word}, 'UTF8_LCASE') AS k", "id", "sha1(CAST(id AS STRING)) AS pad")
    right = spark.range(0, 400, numPartitions=4).selectExpr("collate(if(id = 0, 'HOT', concat('KEY', id)), 'UTF8_LCASE') AS k")
    got, split = split_and_collected(Q.orphans(left, ["k"], right, ["k"]))
    assert split and {r.id for r in got} == {i for i in range(ROWS) if i % 3 and (i % 500 == 0 or i % 500 >= 400)}
