"""Filters, scalar functions, joins and SQL functions on the driver tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from callboard.functions import scalars as S
from callboard.functions import sqlfns
from callboard.operators import aggregates as A
from callboard.operators import changes as C
from callboard.operators import joins as J
from callboard.plans import bindings as B
from callboard.plans.bindings import sql_ratio, sql_roi, with_
from callboard.plans.registry import query
from callboard.plans.views import VIEWS
from callboard.sources import tables

AS_OF = dt.date(2024, 12, 31)


@query("param_sql", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'P'")
def _(d):
    text = "SELECT o_orderkey, o_custkey, o_orderdate FROM {orders} WHERE o_orderstatus = :status"
    return tables.sql(d.spark, text, {"orders": d["orders"]}, status="P")


@query("filter_not_equal", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def _(d):
    return d["orders"].where(F.col("o_orderstatus") != "F").select("o_orderkey", "o_orderstatus")


@query(
    "insert_select",
    """SELECT o_custkey AS crew_id, o_orderkey AS film_id, CAST(o_orderdate AS DATE) AS start_date,
  CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS end_date, c_mktsegment AS department
FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def _(d):
    start = B.day("o_orderdate")
    asked = d["orders"].select(
        F.col("o_custkey").alias("crew_id"),
        F.col("o_orderkey").alias("film_id"),
        start.alias("start_date"),
        S.end_or_default(start, F.lit(None).cast("date"), 30).alias("end_date"),
    )
    return C.insert_select(asked, d["customer"], {"crew_id": "c_custkey"}, {"department": "c_mktsegment"})


# Scalar functions ------------------------------------------------------------------


@query("full_name", "SELECT c_custkey, c_name || ' ' || c_mktsegment AS full_name FROM customer")
def _(d):
    return d["customer"].select("c_custkey", S.full_name("c_name", "c_mktsegment").alias("full_name"))


@query(
    "age_years",
    "SELECT o_orderkey, CAST(2024 - year(o_orderdate) AS INTEGER) AS age FROM orders",
)
def _(d):
    return d["orders"].select("o_orderkey", S.age_or_zero("o_orderdate", AS_OF).alias("age"))


@query(
    "inclusive_days_cost",
    """SELECT o_orderkey, l_linenumber, CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) + 1 AS INTEGER) AS days,
  CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) + 1 AS INTEGER)
    * CAST(l_quantity AS DECIMAL(12,2)) = CAST(l_extendedprice AS DECIMAL(15,2)) AS agrees,
  CAST(CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) + 1 AS INTEGER)
    * CAST(l_quantity AS DECIMAL(12,2)) AS DECIMAL(23,2)) AS cost
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def _(d):
    rows = d["lineitem"].join(d["orders"].select("o_orderkey", "o_orderdate"), F.col("o_orderkey") == F.col("l_orderkey"))
    start, end, rate = B.day("o_orderdate"), B.day("l_shipdate"), B.dec("l_quantity", 12, 2)
    cost = S.stay_cost(start, end, rate)
    return rows.select(
        "o_orderkey",
        "l_linenumber",
        S.inclusive_days(start, end).alias("days"),
        (cost == B.dec("l_extendedprice", 15, 2)).alias("agrees"),
        cost.alias("cost"),
    )


@query(
    "default_end_date",
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS month_end,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE)
       ELSE CAST(CAST(o_orderdate AS DATE) + 7 AS DATE) END AS week_end FROM orders""",
)
def _(d):
    start = B.day("o_orderdate")
    given = F.when(F.col("o_orderstatus") == "F", start)
    return d["orders"].select(
        "o_orderkey",
        S.end_or_default(start, F.lit(None).cast("date"), 30).alias("month_end"),
        S.end_or_default(start, given, 7).alias("week_end"),
    )


@query(
    "split_list",
    """SELECT DISTINCT p_partkey, trim(word) AS word
FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) WHERE trim(word) <> ''""",
)
def _(d):
    return d["part"].select("p_partkey", F.explode(S.split_list("p_name", " ")).alias("word"))


@query(
    "join_list",
    "SELECT p_type, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS brands FROM part GROUP BY p_type",
)
def _(d):
    # Distinct pairs first: the collected list then holds each brand once, however many
    # parts share it.
    pairs = d["part"].select("p_type", "p_brand").distinct()
    return pairs.groupBy("p_type").agg(S.join_list("p_brand").alias("brands"))


@query(
    "format_ts",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS to_minute,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS to_second FROM events""",
)
def _(d):
    return d["events"].select("event_id", S.to_minute("ts").alias("to_minute"), S.to_second("ts").alias("to_second"))


@query(
    "try_numeric",
    """SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
  TRY_CAST(event_type AS DOUBLE) AS not_a_number FROM events""",
)
def _(d):
    digits = F.regexp_extract("props", "[0-9]+", 0)
    return d["events"].select(
        "event_id", S.try_number(digits, "bigint").alias("k"), S.try_number("event_type").alias("not_a_number")
    )


@query(
    "status_label",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Finished' ELSE 'Other' END AS label,
  upper(o_orderpriority) AS priority FROM orders""",
)
def _(d):
    return d["orders"].select(
        "o_orderkey",
        S.label("o_orderstatus", {"O": "Open", "F": "Finished"}, "Other").alias("label"),
        F.upper("o_orderpriority").alias("priority"),
    )


_CENTS = "CAST(CAST(o_totalprice AS DECIMAL(15,2)) * 100 AS BIGINT)"
# Whole dollars, ties to the even one, in whole numbers.
_DOLLARS = f"""({_CENTS} // 100 + CASE WHEN {_CENTS} % 100 > 50
  OR ({_CENTS} % 100 = 50 AND ({_CENTS} // 100) % 2 = 1) THEN 1 ELSE 0 END)"""


@query(
    "format_money",
    f"""SELECT o_orderkey, '$' || format('{{:,}}', {_DOLLARS}) AS amount,
  CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) || '%' AS percent FROM orders""",
)
def _(d):
    amount = B.dec("o_totalprice", 15, 2)
    return d["orders"].select("o_orderkey", S.money(amount).alias("amount"), S.percent(amount).alias("percent"))


@query(
    "message_text",
    """SELECT o_orderkey, 'Film status updated from ' || o_orderstatus || ' to ' || o_orderpriority AS message
FROM orders""",
)
def _(d):
    # Fixed value: the message text.
    text = S.message("Film status updated from {} to {}", "o_orderstatus", "o_orderpriority")
    return d["orders"].select("o_orderkey", text.alias("message"))


# Joins and shares ------------------------------------------------------------------


@query(
    "exists_semi",
    """SELECT c_custkey, c_name FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""",
)
def _(d):
    pending = d["orders"].where("o_orderstatus = 'P'")
    return J.having_match(d["customer"], pending, {"c_custkey": "o_custkey"}).select("c_custkey", "c_name")


@query(
    "not_exists_anti",
    "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
)
def _(d):
    return J.without_match(d["orders"], d["lineitem"], {"o_orderkey": "l_orderkey"}).select("o_orderkey")


@query(
    "share_of_total",
    """WITH g AS (SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS amount
  FROM orders GROUP BY o_orderstatus), t AS (SELECT CAST(sum(amount) * 100 AS HUGEINT) AS total FROM g)
SELECT o_orderstatus, amount, CAST(CAST((2 * CAST(amount * 100 AS HUGEINT) * 10000 + total) // (2 * total)
  AS DECIMAL(20,0)) * 0.01 AS DECIMAL(7,2)) AS share FROM g, t""",
)
def _(d):
    return A.share_of_total(d["orders"], "o_orderstatus", B.dec("o_totalprice", 15, 2))


# SQL functions ---------------------------------------------------------------------


@query(
    "sql_udf_roi",
    with_("gross", "film", "film_money") + "SELECT film_id, profit, roi_percentage FROM film_money",
)
def _(d):
    sqlfns.register(d.spark, {"film": B.film(d)})
    return d.spark.sql(
        """SELECT o_orderkey AS film_id, fn_calculate_film_profit(o_orderkey) AS profit,
             fn_calculate_film_roi(o_orderkey) AS roi_percentage FROM {orders}""",
        orders=d["orders"],
    )


@query(
    "sql_table_fn",
    with_("gross", "film")
    + f"""SELECT c_custkey AS director_id, film_id, release_date,
  CAST(boxoffice_collection - budget AS DECIMAL(26,4)) AS profit,
  {sql_roi("(boxoffice_collection - budget)", "budget")} AS roi_percentage
FROM customer JOIN film ON fk_director_id = c_custkey""",
)
def _(d):
    sqlfns.register(d.spark, {"film": B.film(d)})
    return d.spark.sql(
        "SELECT c.c_custkey AS director_id, f.* FROM {customer} c, LATERAL fn_director_films(c.c_custkey) f",
        customer=d["customer"],
    )


@query(
    "sql_view",
    with_("gross", "film", "film_money")
    + """SELECT production_status, count(*) AS films, CAST(sum(profit) AS DECIMAL(36,4)) AS profit
FROM film_money WHERE boxoffice_collection > 0 GROUP BY production_status""",
)
def _(d):
    view = VIEWS["view_film_profitability"]({"film": B.film(d), "director": B.director(d)}, AS_OF)
    view.createOrReplaceTempView("view_film_profitability")
    return d.spark.sql(
        """SELECT production_status, count(*) AS films, sum(profit) AS profit
             FROM view_film_profitability GROUP BY production_status"""
    )


@query(
    "sql_udf_lookups",
    with_("actor")
    + f""", k AS (SELECT o_orderkey AS k FROM orders UNION ALL SELECT -o_orderkey FROM orders WHERE o_orderstatus = 'P'),
line AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS minutes, count(*) AS scenes,
  CAST({sql_ratio("sum(CAST(l_extendedprice AS DECIMAL(14,2)))", "count(l_extendedprice)", 2, 18, 6)} AS DECIMAL(14,2)) AS salary
  FROM lineitem GROUP BY l_orderkey),
own AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS minutes FROM lineitem
  WHERE l_partkey = l_orderkey GROUP BY l_orderkey),
owner AS (SELECT o_custkey, count(*) AS films, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS money
  FROM orders GROUP BY o_custkey),
part_ AS (SELECT p_partkey, p_brand FROM part),
login AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN 1 ELSE -3 END AS state FROM customer)
SELECT k, CAST(coalesce(2024 - year(dob), 0) AS INTEGER) AS age, coalesce(films, 0) AS films,
  CAST(coalesce(money, 0) AS DECIMAL(25,2)) AS investment, coalesce(line.minutes, 0) AS crew_minutes,
  coalesce(p_brand, 'Unknown') AS availability, coalesce(own.minutes, 0) AS screen_time, coalesce(scenes, 0) AS scenes,
  CAST(coalesce(salary, 0) AS DECIMAL(14,2)) AS salary, CAST(coalesce(state, -1) AS INTEGER) AS login
FROM k LEFT JOIN actor ON actor_id = k LEFT JOIN owner ON o_custkey = k LEFT JOIN line ON line.l_orderkey = k
LEFT JOIN own ON own.l_orderkey = k LEFT JOIN part_ ON p_partkey = k LEFT JOIN login ON c_custkey = k""",
)
def _(d):
    lines = d["lineitem"]
    tables = {
        "actor": B.actor(d),
        "film": B.film_plain(d).withColumn("boxoffice_collection", F.lit(0)),
        "produced_by": d["orders"].select(F.col("o_custkey").alias("producer_id"), B.dec("o_totalprice", 15, 2).alias("investment")),
        "scene_filming": lines.select(F.col("l_orderkey").alias("film_id"), F.col("l_quantity").cast("int").alias("duration_minutes")),
        "scene": lines.select(F.col("l_orderkey").alias("film_id")),
        "equipment": B.equipment(d),
        "role": B.line_role(d),
        "user_metadata": B.account(d),
    }
    sqlfns.register(d.spark, tables, prefix="lookups_")
    orders = d["orders"]
    keys = orders.select(F.col("o_orderkey").alias("k")).unionAll(orders.where("o_orderstatus = 'P'").select((-F.col("o_orderkey")).alias("k")))
    return keys.selectExpr(
        "k", "lookups_fn_get_actor_age(k, DATE'2024-12-31') AS age", "lookups_fn_director_film_count(k) AS films",
        "lookups_fn_producer_total_investment(k) AS investment", "lookups_fn_film_total_crew_hours(k) AS crew_minutes",
        "lookups_fn_equipment_available(k) AS availability", "lookups_fn_actor_screen_time(k, k) AS screen_time",
        "lookups_fn_film_total_scenes(k) AS scenes", "lookups_fn_film_avg_actor_salary(k) AS salary",
        "lookups_fn_authenticate_user(CAST(k AS STRING)) AS login",
    )
