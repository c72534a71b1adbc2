"""Lookup functions over whole key columns, unknown keys included."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from callboard.operators import lookups as L
from callboard.plans import bindings as B
from callboard.plans.bindings import sql_ratio, with_
from callboard.plans.registry import Data, query

AS_OF = dt.date(2024, 12, 31)


def _orders(d: Data):
    return d["orders"].select(F.col("o_orderkey").alias("film_id"))


def _customers_and_misses(d: Data):
    """Order customers, each also negated: the negative keys (but for 0) are unknown."""
    keys = d["orders"].select(F.col("o_custkey").alias("k"))
    return keys.unionByName(d["orders"].select((-F.col("o_custkey")).alias("k")))


_KEYS = "(SELECT o_custkey AS k FROM orders UNION ALL SELECT -o_custkey FROM orders)"


@query("lookup_profit", with_("gross", "film", "film_money") + "SELECT film_id, profit FROM film_money")
def _(d):
    return L.film_profit(_orders(d), B.film(d))


@query("lookup_roi", with_("gross", "film", "film_money") + "SELECT film_id, roi_percentage FROM film_money")
def _(d):
    return L.film_roi(_orders(d), B.film(d))


@query(
    "lookup_age",
    with_("actor")
    + f"""SELECT k AS actor_id, CAST(coalesce(2024 - year(dob), 0) AS INTEGER) AS age
FROM {_KEYS} LEFT JOIN actor ON actor_id = k""",
)
def _(d):
    return L.actor_age(_customers_and_misses(d).withColumnRenamed("k", "actor_id"), B.actor(d), AS_OF)


@query(
    "lookup_child_count",
    """SELECT c_custkey, count(o_orderkey) AS film_count FROM customer
LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def _(d):
    return L.child_count(d["customer"].select("c_custkey"), d["orders"], {"c_custkey": "o_custkey"}, "film_count")


@query(
    "lookup_child_sum",
    """SELECT s_suppkey, CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(15,2))), 0) AS DECIMAL(25,2))
  AS total_investment FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey""",
)
def _(d):
    keys = d["supplier"].select("s_suppkey")
    return L.child_sum(keys, B.produced_by(d), {"s_suppkey": "producer_id"}, "investment", "total_investment")


@query(
    "lookup_minutes",
    """SELECT o_orderkey AS film_id, CAST(coalesce(sum(CAST(l_quantity AS INTEGER)), 0) AS BIGINT) AS total_crew_minutes
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
)
def _(d):
    return L.child_sum(_orders(d), B.shoot(d), {"film_id": "film_id"}, "duration_minutes", "total_crew_minutes")


@query(
    "lookup_status",
    f"""SELECT k, coalesce(c_mktsegment, 'Unknown') AS status
FROM {_KEYS} LEFT JOIN customer ON c_custkey = k""",
)
def _(d):
    return L.status_or_unknown(_customers_and_misses(d), d["customer"], {"k": "c_custkey"}, "c_mktsegment")


@query(
    "lookup_pair_sum",
    """WITH p AS (SELECT DISTINCT l_partkey AS actor_id, l_orderkey AS film_id FROM lineitem),
k AS (SELECT * FROM p UNION ALL SELECT -1 - actor_id, film_id FROM p)
SELECT actor_id, film_id, CAST(coalesce(sum(CAST(l_quantity AS INTEGER)), 0) AS BIGINT) AS screen_time
FROM k LEFT JOIN lineitem ON l_partkey = actor_id AND l_orderkey = film_id GROUP BY actor_id, film_id""",
)
def _(d):
    role = B.line_role(d)
    known = role.select("actor_id", "film_id").distinct()
    keys = known.unionByName(known.select((-1 - F.col("actor_id")).alias("actor_id"), "film_id"))
    return L.child_sum(keys, role, {"actor_id": "actor_id", "film_id": "film_id"}, "screen_time", "screen_time")


@query(
    "lookup_scene_count",
    """SELECT o_orderkey AS film_id, count(l_orderkey) AS scene_count FROM orders
LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
)
def _(d):
    return L.child_count(_orders(d), d["lineitem"], {"film_id": "l_orderkey"}, "scene_count")


@query(
    "lookup_child_avg",
    f"""SELECT o_orderkey AS film_id, CAST(coalesce({sql_ratio(
        "sum(CAST(l_extendedprice AS DECIMAL(14,2)))", "count(l_extendedprice)", 2, 14, 2)}, 0)
  AS DECIMAL(14,2)) AS avg_salary
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
)
def _(d):
    return L.child_average(_orders(d), B.line_role(d), {"film_id": "film_id"}, "salary", "avg_salary")


@query(
    "account_state",
    with_("account")
    + """SELECT k AS username, CAST(CASE WHEN role IS NULL THEN -1 WHEN NOT is_active THEN -3 ELSE 1 END AS INTEGER)
  AS state
FROM (SELECT user_id AS k FROM events UNION ALL SELECT -1 - user_id FROM events)
LEFT JOIN account ON username = k""",
)
def _(d):
    ids = d["events"].select(F.col("user_id").alias("username"))
    keys = ids.unionByName(ids.select((-1 - F.col("username")).alias("username")))
    return L.account_state(keys, B.account(d))
