"""Reports called from SQL for many keys, reports over shared tables, mergeable counts and collated keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callboard.operators import aggregates as A
from callboard.operators import changes as C
from callboard.operators import quality as Q
from callboard.plans import batch, views
from callboard.plans import bindings as B
from callboard.plans import queries_reports as QR
from callboard.plans import reports as R
from callboard.plans.bindings import with_
from callboard.plans.registry import ORACLE, Data, query
from callboard.sources import working

# Procedures from SQL ---------------------------------------------------------------


def _called(name: str, sql: str, tables: Callable[[Data], dict[str, DataFrame]], procedure: str, text: str, key: str | None = None) -> None:
    """Register a query that calls a procedure in ``text``, over the keys of a driver table if it takes one."""

    @query(name, sql)
    def _(d):
        prefix = f"{name}_"
        views.register_procedures(d.spark, tables(d), [procedure], prefix)
        call = text.replace("sp_", f"{prefix}sp_", 1)
        return d.spark.sql(call, **({key: d[key]} if key else {}))


_called(
    "sql_actor_filmography", ORACLE["actor_filmography"],
    lambda d: {"role": B.line_role(d), "film": B.film_plain(d), "director": B.director(d)},
    "sp_get_actor_filmography", "SELECT r.* FROM {part} k, LATERAL sp_get_actor_filmography(k.p_partkey) r", "part",
)
_called(
    "sql_producer_investment",
    f"SELECT * EXCLUDE (portfolio_films), portfolio_films AS total_films FROM ({ORACLE['producer_investment']})",
    lambda d: {"producer": B.producer(d), "produced_by": B.produced_by(d)},
    "sp_calculate_producer_investment", "SELECT r.* FROM {supplier} k, LATERAL sp_calculate_producer_investment(k.s_suppkey) r", "supplier",
)
_called(
    "sql_production_summary", ORACLE["production_summary"], QR.production_tables,
    "sp_get_film_production_summary", "SELECT r.* FROM {orders} k, LATERAL sp_get_film_production_summary(k.o_orderkey) r", "orders",
)
_called(
    "sql_crew_payroll", ORACLE["crew_payroll"],
    lambda d: {"crew": B.supplier_crew(d), "works_on": B.shipping_span(d), "scene_filming": B.shoot(d).where(F.col("notes") == "R")},
    "sp_get_film_crew_payroll", "SELECT r.* FROM {orders} k, LATERAL sp_get_film_crew_payroll(k.o_orderkey) r", "orders",
)
_called(
    "sql_equipment_usage", ORACLE["equipment_usage"],
    lambda d: {"equipment": B.equipment(d), "film_crew_equipment": B.booking(d),
               "scene_filming": B.shoot({"lineitem": d["lineitem"].where("l_linestatus = 'F'")})},
    "sp_get_equipment_usage_report", "SELECT r.* FROM {orders} k, LATERAL sp_get_equipment_usage_report(k.o_orderkey) r", "orders",
)
_called(
    "sql_award_history", ORACLE["award_history"],
    lambda d: {"actor": B.actor(d), "actor_award": B.urgent_award(d)},
    "sp_get_actor_award_history", "SELECT r.* FROM {customer} k, LATERAL sp_get_actor_award_history(k.c_custkey) r", "customer",
)
_called(
    "sql_boxoffice_analysis", ORACLE["boxoffice_analysis"],
    lambda d: {"film": B.film(d), "director": B.director(d), "role": B.line_role(d)},
    "sp_get_boxoffice_analysis", "SELECT * FROM sp_get_boxoffice_analysis()",
)
_called(
    "sql_distributor_performance", ORACLE["distributor_performance"],
    lambda d: {"distributor": B.distributor(d), "distributes": B.distributes(d), "film": B.film(d)},
    "sp_get_distributor_performance", "SELECT * FROM sp_get_distributor_performance()",
)


# Reports over shared tables ----------------------------------------------------------

#: Reports that all need the films' box office.
MONEY_REPORTS: dict[str, batch.Report] = {
    "film_profitability": lambda t: R.film_profitability(t, ordered=False),
    "boxoffice_analysis": lambda t: R.boxoffice_analysis(t, ordered=False),
    "director_films_with_profit": lambda t: R.director_films_with_profit(t, ordered=False),
    "director_filmography": R.director_filmography,
    "director_portfolio": R.director_portfolio,
    "film_listing": R.film_listing,
}


@query(
    "report_batch",
    with_("gross", "film", "film_money", "director")
    + """SELECT 'film_profitability' AS report, film_id AS id, CAST(profit AS DECIMAL(35,4)) AS amount FROM film_money WHERE boxoffice_collection > 0
UNION ALL SELECT 'boxoffice_analysis', film_id, CAST(profit AS DECIMAL(35,4)) FROM film_money WHERE boxoffice_collection > 0
UNION ALL SELECT 'director_films_with_profit', film_id, CAST(profit AS DECIMAL(35,4)) FROM film_money WHERE fk_director_id IS NOT NULL
UNION ALL SELECT 'director_filmography', director_id, CAST(sum(boxoffice_collection) AS DECIMAL(35,4))
  FROM director LEFT JOIN film ON fk_director_id = director_id GROUP BY director_id
UNION ALL SELECT 'director_portfolio', director_id, CAST(sum(boxoffice_collection) AS DECIMAL(35,4))
  FROM director LEFT JOIN film ON fk_director_id = director_id GROUP BY director_id
UNION ALL SELECT 'film_listing', film_id, CAST(boxoffice_collection AS DECIMAL(35,4)) FROM film""",
)
def _(d):
    """Six reports on one scan of the line items: the films with their box office are written once."""
    tables = {"film": B.film(d), "director": B.director(d), "role": B.line_role(d)}
    rows = None
    for name, report in batch.run(tables, MONEY_REPORTS).items():
        key = "film_id" if "film_id" in report.columns else "director_id"
        amount = next(c for c in ("profit", "total_boxoffice", "boxoffice_collection") if c in report.columns)
        part = report.select(F.lit(name).alias("report"), F.col(key).alias("id"), F.col(amount).cast("decimal(35,4)").alias("amount"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


# Distinct counts that add up ---------------------------------------------------------


@query("production_summary_bitmaps", ORACLE["production_summary"])
def _(d):
    return R.production_summary(QR.production_tables(d), bitmaps=True)


@query("scene_filming_summary_bitmaps", ORACLE["scene_filming_summary"])
def _(d):
    return R.scene_filming_summary(QR.scene_tables(d), bitmaps=True)


@query(
    "distinct_users_rollup",
    """SELECT event_type, CAST(month(ts) AS INTEGER) AS month, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days
FROM events WHERE user_id IS NOT NULL GROUP BY event_type, month(ts)""",
)
def _(d):
    """Distinct users per kind of event and month, added up from stored bitmaps per day."""
    days = d["events"].select("event_type", F.to_date("ts").alias("day"), "user_id")
    daily = working.table(A.distinct_sketch(days, ["event_type", "day"], "user_id"), "daily")
    monthly = daily.withColumn("month", F.month("day"))
    users = A.sketched_counts(A.united_sketches(monthly, ["event_type", "month"]), ["event_type", "month"], "users")
    active = monthly.groupBy(F.col("event_type").alias("_t"), F.col("month").alias("_m")).agg(F.count_distinct("day").alias("days"))
    return users.join(active, (F.col("event_type") == F.col("_t")) & (F.col("month") == F.col("_m"))).drop("_t", "_m")


# Keys under a collation ----------------------------------------------------------------

#: Case doesn't matter, as for keys of the catalogue's server.
NOCASE = "UTF8_LCASE"


@query(
    "insert_ignore_collated",
    """WITH b AS (SELECT upper(c_name) AS name, CAST(0 AS BIGINT) AS asked FROM customer WHERE c_acctbal > 5000),
n AS (SELECT CASE WHEN o_orderstatus = 'F' THEN upper(c_name) ELSE lower(c_name) END AS name, o_orderkey
  FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT name, asked FROM b UNION ALL
SELECT arg_min(name, o_orderkey), min(o_orderkey) FROM n WHERE lower(name) NOT IN (SELECT lower(name) FROM b) GROUP BY lower(name)""",
)
def _(d):
    """Requests whose names differ from known ones in case only are ignored."""
    known = d["customer"].where("c_acctbal > 5000").select(F.upper("c_name").alias("name"), F.lit(0).cast("bigint").alias("asked"))
    asked = d["orders"].join(d["customer"], F.col("c_custkey") == F.col("o_custkey"))
    name = F.when(F.col("o_orderstatus") == "F", F.upper("c_name")).otherwise(F.lower("c_name"))
    return C.insert_ignore(known, asked.select(name.alias("name"), F.col("o_orderkey").alias("asked")), ["name"], ["asked"], collation=NOCASE)


@query(
    "dq_unique_collated",
    """SELECT lower(k) AS k, count(*) AS rows FROM (
  SELECT CASE WHEN l_linestatus = 'F' THEN upper(p_name) ELSE lower(p_name) END AS k FROM lineitem JOIN part ON p_partkey = l_partkey)
GROUP BY lower(k) HAVING count(*) > 1""",
)
def _(d):
    """Duplicates of a key whose column is compared without regard to case."""
    rows = d["lineitem"].join(d["part"], F.col("p_partkey") == F.col("l_partkey"))
    k = F.when(F.col("l_linestatus") == "F", F.upper("p_name")).otherwise(F.lower("p_name"))
    found = Q.duplicate_keys(rows.select(F.collate(k, NOCASE).alias("k")), ["k"])
    return found.select(F.lower(F.collate("k", "UTF8_BINARY")).alias("k"), "rows")


@query(
    "dq_orphans_collated",
    """SELECT l_orderkey, l_linenumber, lower(p_brand) AS brand FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE lower(p_brand) NOT IN (SELECT lower(p_brand) FROM part WHERE p_size > 40)""",
)
def _(d):
    """References to keys that exist in another case only are no orphans; the join is spread over a hot key."""
    lines = d["lineitem"].join(d["part"], F.col("p_partkey") == F.col("l_partkey"))
    child = lines.select("l_orderkey", "l_linenumber", F.collate(F.lower("p_brand"), NOCASE).alias("brand"))
    parent = d["part"].where("p_size > 40").select(F.collate(F.upper("p_brand"), NOCASE).alias("brand"))
    found = Q.orphans(child, ["brand"], parent, ["brand"])
    return found.select("l_orderkey", "l_linenumber", F.collate("brand", "UTF8_BINARY").alias("brand"))
