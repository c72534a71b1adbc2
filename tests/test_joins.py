import random

from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from callboard.operators import aggregates as A
from callboard.operators import joins as J
from callboard.operators import lookups as L
from callboard.plans import reports as R


def skewed(spark, n=3000, keys=40, seed=7):
    """Rows of which a third share one key."""
    pick = random.Random(seed)
    data = [(0 if i % 3 == 0 else pick.randrange(keys), pick.randrange(50), i) for i in range(n)]
    return spark.createDataFrame(data, "k int, member int, id int")


def test_separate_children_equal_the_raw_star_join(spark):
    parents = spark.range(45).select(F.col("id").cast("int").alias("k"))
    a, b = skewed(spark, 300, seed=1), skewed(spark, 300, seed=2)
    got = J.attach(parents, a, {"k": "k"}, {"na": F.count_distinct("member")}, {"na": 0})
    got = J.attach(got, b, {"k": "k"}, {"nb": F.count_distinct("member")}, {"nb": 0})
    star = parents.join(a.withColumnRenamed("member", "ma").drop("id"), "k", "left")
    star = star.join(b.withColumnRenamed("member", "mb").drop("id"), "k", "left")
    star = star.groupBy("k").agg(F.count_distinct("ma").alias("na"), F.count_distinct("mb").alias("nb"))
    assert rows(got) == rows(star)


def test_details_with_count_equal_a_window_over_the_left_join(spark):
    parents = spark.range(45).select(F.col("id").cast("int").alias("p"))
    child = skewed(spark)
    got = J.details_with_count(parents, child, {"p": "k"}, ["member", "id"], "total")
    left = parents.join(child, F.col("p") == F.col("k"), "left")
    window = left.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("p")))
    assert rows(got) == rows(window.select("p", "member", "id", "total"))


def test_weighted_average_equals_the_average_after_a_fan_out(spark, make):
    crew = make([(1, "A", 10), (2, "A", 1), (3, "A", None), (4, "B", 5), (5, None, 9)],
                "crew_id int, department string, experience_years int")
    works = make([(1, 7, "x"), (1, 8, "x"), (1, 9, "x"), (3, 7, "x")], "crew_id int, film_id int, department string")
    got = rows(R.crew_by_department({"crew": crew, "works_on": works}))
    assert got == [("A", 3, "7.7500", 10, 3), ("B", 1, "5.0000", 5, 0)]
    plain = rows(R.department_headcount({"crew": crew}))
    assert plain == [("A", 3, "5.5000"), ("B", 1, "5.0000")]


def test_semi_and_anti_joins_split_the_rows(make):
    left = make([(1,), (2,), (None,)], "k int")
    right = make([(1,), (1,)], "r int")
    assert rows(J.having_match(left, right, {"k": "r"})) == [(1,)]
    assert rows(J.without_match(left, right, {"k": "r"})) == [(2,), (None,)]


def test_first_by_takes_the_smallest(make):
    df = make([(1, 5, "b"), (1, 3, "a"), (2, 9, None)], "k int, o int, v string")
    assert rows(A.first_by(df, ["k"], ["o"])) == [(1, 3, "a"), (2, 9, None)]


def test_value_counts_shares_and_totals(make):
    df = make([("a", "1.00"), ("a", "2.00"), ("b", "3.00"), (None, "0.00")], "s string, x decimal(15,2)")
    assert [tuple(r) for r in A.value_counts(df, "s").collect()] == [("a", 2), ("b", 1)]
    assert rows(A.share_of_total(df, "s", F.col("x")), "s", "share") == [("a", "50.00"), ("b", "50.00"), (None, "0.00")]
    none = A.totals((df.where("false"), [F.sum("x").alias("s"), F.count(F.lit(1)).alias("n")]))
    assert rows(none) == [(None, 0)]


def test_kpis_of_empty_tables_are_zero(seed):
    empty = {name: df.where("false") for name, df in seed.items()}
    assert rows(R.kpi_totals(empty)) == [(0, 0, "0.00", "0.00")]
    assert R.film_profitability(empty).count() == 0
    assert R.crew_by_department(empty).count() == 0


def test_lookup_defaults_and_two_part_key(make):
    keys = make([(1, 1), (1, 2), (9, 9)], "actor_id int, film_id int")
    role = make([(1, 1, 40), (1, 1, 2), (1, 2, None)], "actor_id int, film_id int, screen_time int")
    on = {"actor_id": "actor_id", "film_id": "film_id"}
    assert rows(L.child_sum(keys, role, on, "screen_time", "t")) == [(1, 1, 42), (1, 2, 0), (9, 9, 0)]
    assert rows(L.child_count(keys, role, on, "n")) == [(1, 1, 2), (1, 2, 1), (9, 9, 0)]


def test_average_salary_rounds_to_cents(make):
    keys = make([(1,), (2,)], "film_id int")
    role = make([(1, "0.01"), (1, "0.02"), (1, "0.02")], "film_id int, salary decimal(14,2)")
    assert rows(L.child_average(keys, role, {"film_id": "film_id"}, "salary", "a")) == [(1, "0.02"), (2, "0.00")]


def test_status_and_account_state(make):
    keys = make([("a",), ("b",), ("c",), ("d",), ("x",)], "username string")
    accounts = make([("a", "admin", True), ("b", "viewer", False), ("c", None, True), ("d", "viewer", None)],
                    "username string, role string, is_active boolean")
    assert rows(L.account_state(keys, accounts)) == [("a", 1), ("b", -3), ("c", -1), ("d", 1), ("x", -1)]
    got = L.status_or_unknown(keys, accounts, {"username": "username"}, "role")
    assert rows(got) == [("a", "admin"), ("b", "viewer"), ("c", "Unknown"), ("d", "viewer"), ("x", "Unknown")]


def test_namesakes_with_equal_awards_collapse(seed, make):
    people = make([(1, "Sam", "A"), (2, "Sam", "B")], "actor_id int, first_name string, last_name string")
    awards = make([(1, "Best", 2000), (2, "Best", 2000)], "actor_id int, award_name string, award_year int")
    got = R.recent_awards({**seed, "actor": people, "actor_award": awards})
    assert rows(got.where("type = 'Actor'")) == [("Actor", "Sam", "Best", 2000)]


def test_producer_without_films_has_null_sums(seed, make):
    lonely = make([(9, "Nobody", None)], "producer_id int, name string, company string")
    got = rows(R.producer_investment({**seed, "producer": lonely}))
    assert got == [(9, "Nobody", None, 0, None, None, None, None)]
