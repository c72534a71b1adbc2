"""Catalogue frames derived from the driver tables, and the same frames as SQL text.

Each role of the catalogue is played by one driver table under renamed columns: an order
is a film, a customer a director, actor, crew member or account, a line item a casting,
contract, booking or shoot, an event an activity-log row. Nothing is filtered away
except where a report needs parents without children.

For each frame here ``CTE`` holds the SQL that builds it for the reference queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callboard.plans.registry import Data

CTE: dict[str, str] = {}


def with_(*names: str) -> str:
    """``WITH`` clause made of the named frames."""
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in names) + "\n"


def sql_roi(profit: str, budget: str) -> str:
    """Percent with two decimals, rounded half away from zero in whole numbers."""
    p, b = f"CAST({profit} * 10000 AS HUGEINT)", f"CAST({budget} * 100 AS HUGEINT)"
    return (
        f"CAST(CASE WHEN {budget} > 0 THEN CAST(sign({p}) * ((200 * abs({p}) + {b}) // (2 * {b})) "
        f"AS DECIMAL(20,0)) * 0.01 ELSE 0 END AS DECIMAL(18,2))"
    )


def sql_ratio(total: str, count: str, scale_in: int, precision: int, scale: int) -> str:
    """Decimal quotient rounded half away from zero in whole numbers; NULL over nothing."""
    n = f"CAST({total} * {10**scale_in} AS HUGEINT)"
    step = "0." + "0" * (scale - 1) + "1"
    return (
        f"CASE WHEN {count} <> 0 THEN CAST(CAST(sign({n}) * ((2 * abs({n}) * {10 ** (scale - scale_in)} + {count}) "
        f"// (2 * {count})) AS DECIMAL(27,0)) * {step} AS DECIMAL({precision},{scale})) END"
    )


def dec(column: str, precision: int, scale: int) -> Column:
    return F.col(column).cast(f"decimal({precision},{scale})")


def day(column: str) -> Column:
    return F.to_date(column)


# Films -----------------------------------------------------------------------------

CTE["gross"] = """SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))
  * (1 - CAST(l_discount AS DECIMAL(5,2)))) AS DECIMAL(25,4)) AS g FROM lineitem GROUP BY l_orderkey"""
_FILM = """o_orderkey AS film_id, o_orderpriority || ' #' || o_orderkey AS title,
  CAST(o_orderdate AS DATE) AS release_date, CAST(o_totalprice AS DECIMAL(15,2)) AS budget,
  CAST(dayofyear(o_orderdate) AS INTEGER) AS duration, lower(o_orderpriority) AS language,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(month(o_orderdate) AS DECIMAL(3,1)) END AS rating,
  o_custkey AS fk_director_id, o_orderpriority AS primary_genre, o_orderstatus AS production_status,
  o_orderdate AS created_date"""
CTE["film_plain"] = f"SELECT {_FILM} FROM orders"
CTE["film"] = f"""SELECT {_FILM}, coalesce(g, 0) AS boxoffice_collection
  FROM orders LEFT JOIN gross ON l_orderkey = o_orderkey"""
CTE["film_money"] = f"""SELECT *, CAST(boxoffice_collection - budget AS DECIMAL(26,4)) AS profit,
  {sql_roi("(boxoffice_collection - budget)", "budget")} AS roi_percentage FROM film"""


def film_plain(d: Data) -> DataFrame:
    """Orders as films, without box office: no line item is read."""
    return d["orders"].select(
        F.col("o_orderkey").alias("film_id"),
        F.concat("o_orderpriority", F.lit(" #"), F.col("o_orderkey").cast("string")).alias("title"),
        day("o_orderdate").alias("release_date"),
        dec("o_totalprice", 15, 2).alias("budget"),
        F.dayofyear("o_orderdate").alias("duration"),
        F.lower("o_orderpriority").alias("language"),
        F.when(F.col("o_orderstatus") != "P", F.month("o_orderdate").cast("decimal(3,1)")).alias("rating"),
        F.col("o_custkey").alias("fk_director_id"),
        F.col("o_orderpriority").alias("primary_genre"),
        F.col("o_orderstatus").alias("production_status"),
        F.col("o_orderdate").alias("created_date"),
    )


def line_revenue() -> Column:
    """Discounted price of a line, exact in four decimals."""
    return dec("l_extendedprice", 15, 2) * (1 - dec("l_discount", 5, 2))


def film(d: Data) -> DataFrame:
    """Orders as films with the revenue of their lines as box office, 0 without lines."""
    gross = d["lineitem"].groupBy("l_orderkey").agg(F.sum(line_revenue()).cast("decimal(25,4)").alias("g"))
    joined = film_plain(d).join(gross, F.col("film_id") == F.col("l_orderkey"), "left")
    none = F.lit(0).cast("decimal(25,4)")
    return joined.withColumn("boxoffice_collection", F.coalesce("g", none)).drop("g", "l_orderkey")


# People ----------------------------------------------------------------------------

_DOB = "CASE WHEN c_acctbal >= 0 THEN CAST(DATE '1950-01-01' + CAST(c_nationkey * 400 AS INTEGER) AS DATE) END AS dob"
CTE["director"] = f"SELECT c_custkey AS director_id, c_name AS name, c_mktsegment AS nationality, {_DOB} FROM customer"
CTE["actor"] = f"""SELECT c_custkey AS actor_id, c_name AS first_name, c_mktsegment AS last_name, {_DOB},
  'Other' AS gender, CAST(c_nationkey AS VARCHAR) AS nationality,
  lower(c_mktsegment) AS stage_name FROM customer"""
CTE["crew"] = """SELECT c_custkey AS crew_id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS role,
  CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_mktsegment END AS department,
  CAST(floor(c_acctbal / 100) AS INTEGER) AS experience_years FROM customer"""


def _dob() -> Column:
    born = F.date_add(F.lit("1950-01-01").cast("date"), F.col("c_nationkey") * 400)
    return F.when(F.col("c_acctbal") >= 0, born).alias("dob")


def director(d: Data) -> DataFrame:
    return d["customer"].select(
        F.col("c_custkey").alias("director_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("nationality"),
        _dob(),
    )


def actor(d: Data) -> DataFrame:
    return d["customer"].select(
        F.col("c_custkey").alias("actor_id"),
        F.col("c_name").alias("first_name"),
        F.col("c_mktsegment").alias("last_name"),
        _dob(),
        F.lit("Other").alias("gender"),
        F.col("c_nationkey").cast("string").alias("nationality"),
        F.lower("c_mktsegment").alias("stage_name"),
    )


def crew(d: Data) -> DataFrame:
    """Customers as crew; one market segment has no department."""
    return d["customer"].select(
        F.col("c_custkey").alias("crew_id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").cast("string").alias("role"),
        F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.col("c_mktsegment")).alias("department"),
        F.floor(F.col("c_acctbal") / 100).cast("int").alias("experience_years"),
    )


def supplier_crew(d: Data) -> DataFrame:
    return d["supplier"].select(
        F.col("s_suppkey").alias("crew_id"),
        F.col("s_name").alias("name"),
        F.lit("Supplier").alias("role"),
        F.col("s_nationkey").cast("string").alias("department"),
    )


def casting(d: Data) -> DataFrame:
    """Orders as castings of customers."""
    return d["orders"].select(F.col("o_custkey").alias("actor_id"), F.col("o_orderkey").alias("film_id"))


def line_role(d: Data) -> DataFrame:
    """Line items as castings of parts."""
    return d["lineitem"].select(
        F.col("l_partkey").alias("actor_id"),
        F.col("l_orderkey").alias("film_id"),
        F.col("l_returnflag").alias("character_name"),
        F.col("l_quantity").cast("int").alias("screen_time"),
        F.col("l_linestatus").alias("importance"),
        dec("l_extendedprice", 14, 2).alias("salary"),
    )


def assignment(d: Data) -> DataFrame:
    """Orders as assignments of customers."""
    return d["orders"].select(F.col("o_custkey").alias("crew_id"), F.col("o_orderkey").alias("film_id"))


def shipping_span(d: Data) -> DataFrame:
    """Assignments of suppliers to orders, from first to last shipping day."""
    spans = d["lineitem"].groupBy("l_suppkey", "l_orderkey").agg(
        F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last")
    )
    return spans.select(
        F.col("l_suppkey").alias("crew_id"),
        F.col("l_orderkey").alias("film_id"),
        day("first").alias("start_date"),
        day("last").alias("end_date"),
    )


# Money partners --------------------------------------------------------------------


def producer(d: Data) -> DataFrame:
    return d["supplier"].select(
        F.col("s_suppkey").alias("producer_id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("Company "), F.col("s_nationkey").cast("string")).alias("company"),
    )


def produced_by(d: Data) -> DataFrame:
    return d["lineitem"].select(
        F.col("l_suppkey").alias("producer_id"),
        F.col("l_orderkey").alias("film_id"),
        dec("l_extendedprice", 15, 2).alias("investment"),
    )


def distributor(d: Data) -> DataFrame:
    return d["supplier"].select(
        F.col("s_suppkey").alias("distributor_id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("region"),
        dec("s_nationkey", 5, 2).alias("market_share"),
    )


def distributes(d: Data) -> DataFrame:
    return d["lineitem"].select(
        F.col("l_suppkey").alias("distributor_id"),
        F.col("l_orderkey").alias("film_id"),
        dec("l_extendedprice", 15, 2).alias("distribution_fee"),
    )


# Equipment, scenes, places ---------------------------------------------------------


def equipment(d: Data) -> DataFrame:
    return d["part"].select(
        F.col("p_partkey").alias("equipment_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("type"),
        dec("p_retailprice", 12, 2).alias("cost"),
        F.col("p_brand").alias("availability"),
        F.col("p_size").cast("string").alias("condition"),
    )


def booking(d: Data) -> DataFrame:
    return d["lineitem"].select(
        F.col("l_orderkey").alias("film_id"),
        F.col("l_suppkey").alias("crew_id"),
        F.col("l_partkey").alias("equipment_id"),
        F.col("l_quantity").cast("int").alias("days_used"),
        dec("l_discount", 3, 2).alias("efficiency_rating"),
        (F.col("l_returnflag") == "R").alias("maintenance_required"),
    )


def shoot(d: Data) -> DataFrame:
    """Line items as shoots of the scene, and film, that their order is."""
    return d["lineitem"].select(
        F.col("l_orderkey").alias("scene_id"),
        F.col("l_orderkey").alias("film_id"),
        F.col("l_suppkey").alias("crew_id"),
        F.col("l_partkey").alias("equipment_id"),
        F.col("l_linenumber").alias("filming_id"),
        F.col("l_quantity").cast("int").alias("duration_minutes"),
        F.col("l_returnflag").alias("notes"),
    )


CTE["place"] = """SELECT s_suppkey AS location_id, s_name AS name, n_name AS city,
  CAST(s_nationkey AS VARCHAR) AS state, r_name AS country, CAST(s_acctbal AS DECIMAL(12,2)) AS cost_per_day,
  upper(s_name) AS area
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey"""


def place(d: Data) -> DataFrame:
    rows = d["supplier"].join(d["nation"], F.col("n_nationkey") == F.col("s_nationkey"))
    rows = rows.join(d["region"], F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.select(
        F.col("s_suppkey").alias("location_id"),
        F.col("s_name").alias("name"),
        F.col("n_name").alias("city"),
        F.col("s_nationkey").cast("string").alias("state"),
        F.col("r_name").alias("country"),
        dec("s_acctbal", 12, 2).alias("cost_per_day"),
        F.upper("s_name").alias("area"),
    )


# Awards ----------------------------------------------------------------------------


def urgent_award(d: Data) -> DataFrame:
    """Finished urgent orders as awards of customers; about half of them have none."""
    won = d["orders"].where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"))
    return won.select(
        F.col("o_custkey").alias("actor_id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("award_name"),
        F.year("o_orderdate").alias("award_year"),
    )


def finished_award(d: Data) -> DataFrame:
    won = d["orders"].where(F.col("o_orderstatus") == "F")
    return won.select(
        F.col("o_custkey").alias("director_id"),
        F.col("o_orderpriority").alias("award_name"),
        F.year("o_orderdate").alias("award_year"),
    )


def line_award(d: Data, who: str, column: str) -> DataFrame:
    won = d["lineitem"].where(F.col("l_returnflag") == "R")
    return won.select(
        F.col(column).alias(who), F.col("l_linestatus").alias("award_name"), F.year("l_shipdate").alias("award_year")
    )


# Users and logs --------------------------------------------------------------------

CTE["account"] = """SELECT c_custkey AS username, c_name AS full_name, c_name || '@example.org' AS email,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'admin' WHEN 'MACHINERY' THEN 'manager' ELSE 'viewer' END AS role,
  c_acctbal >= 0 AS is_active, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey) AS created_at,
  c_mktsegment AS created_by,
  CASE WHEN c_acctbal >= 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds(c_custkey * 90) END AS last_login
  FROM customer"""


def account(d: Data) -> DataFrame:
    start = "timestamp_ntz'2024-01-01 00:00:00'"
    return d["customer"].select(
        F.col("c_custkey").alias("username"),
        F.col("c_name").alias("full_name"),
        F.concat("c_name", F.lit("@example.org")).alias("email"),
        F.when(F.col("c_mktsegment") == "BUILDING", "admin")
        .when(F.col("c_mktsegment") == "MACHINERY", "manager")
        .otherwise("viewer")
        .alias("role"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
        F.expr(f"{start} + INTERVAL '1' MINUTE * c_custkey").alias("created_at"),
        F.col("c_mktsegment").alias("created_by"),
        F.when(F.col("c_acctbal") >= 0, F.expr(f"{start} + INTERVAL '90' SECOND * c_custkey")).alias("last_login"),
    )


def activity(d: Data) -> DataFrame:
    """Events as log rows: a signup is a successful login, an error a failed one."""
    kind = (
        F.when(F.col("event_type") == "signup", "LOGIN_SUCCESS")
        .when(F.col("event_type") == "error", "LOGIN_FAILED")
        .otherwise(F.col("event_type"))
    )
    return d["events"].select(
        F.col("event_id").alias("log_id"),
        F.col("user_id").alias("username"),
        kind.alias("action_type"),
        F.col("props").alias("action_description"),
        F.col("ts").alias("timestamp"),
    )


CTE["activity"] = """SELECT event_id AS log_id, user_id AS username,
  CASE event_type WHEN 'signup' THEN 'LOGIN_SUCCESS' WHEN 'error' THEN 'LOGIN_FAILED' ELSE event_type END AS action_type,
  props AS action_description, ts AS "timestamp" FROM events"""
