"""The named reports on the driver tables, each with its reference SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callboard.operators import aggregates as A
from callboard.plans import bindings as B
from callboard.plans import reports as R
from callboard.plans.bindings import sql_ratio, with_
from callboard.plans.registry import ORACLE, Data, query

AS_OF = dt.date(2024, 12, 31)

_FILM_BASIC = """SELECT film_id, title, release_date, budget, duration, language, rating, production_status,
  d.name AS director_name, created_date
FROM film_plain LEFT JOIN director d ON d.director_id = fk_director_id"""


# Tables of reports that several queries run.


def scene_tables(d: Data) -> dict[str, DataFrame]:
    scene = d["orders"].select(
        F.col("o_orderkey").alias("scene_id"),
        F.col("o_custkey").alias("film_id"),
        F.col("o_orderpriority").alias("location"),
        F.col("o_orderstatus").alias("description"),
        F.dayofyear("o_orderdate").alias("duration"),
    )
    film = d["customer"].select(F.col("c_custkey").alias("film_id"), F.col("c_name").alias("title"))
    return {"scene": scene, "film": film, "scene_filming": B.shoot(d)}


def production_tables(d: Data) -> dict[str, DataFrame]:
    lines = d["lineitem"]
    by_film = F.col("l_orderkey").alias("film_id")
    return {
        "film": B.film_plain(d),
        "director": B.director(d),
        "role": B.line_role(d),
        "scene": lines.select(by_film, F.col("l_linenumber").alias("scene_id")),
        "works_on": lines.select(by_film, F.col("l_suppkey").alias("crew_id")),
        "shot_at": lines.select(by_film, F.col("l_suppkey").alias("location_id")),
        "shooting_location": d["supplier"]
        .where("s_acctbal >= 5000")
        .select(F.col("s_suppkey").alias("location_id")),
    }


@query("film_basic", with_("film_plain", "director") + _FILM_BASIC)
def _(d):
    return R.film_basic({"film": B.film_plain(d), "director": B.director(d)})


@query("film_basic_preview", with_("film_plain", "director") + _FILM_BASIC + " ORDER BY film_id LIMIT 10")
def _(d):
    return R.film_basic({"film": B.film_plain(d), "director": B.director(d)}, limit=10)


@query(
    "film_profitability",
    with_("gross", "film", "film_money", "director")
    + """SELECT film_id, title, budget, boxoffice_collection, profit, roi_percentage, d.name AS director,
  production_status
FROM film_money LEFT JOIN director d ON d.director_id = fk_director_id WHERE boxoffice_collection > 0""",
)
def film_profitability(d):
    return R.film_profitability({"film": B.film(d), "director": B.director(d)})


@query(
    "actor_details",
    with_("actor")
    + """SELECT actor_id, first_name || ' ' || last_name AS full_name, stage_name, dob,
  CAST(coalesce(2024 - year(dob), 0) AS INTEGER) AS age, gender, nationality,
  count(DISTINCT o_orderkey) AS total_films
FROM actor LEFT JOIN orders ON o_custkey = actor_id
GROUP BY actor_id, first_name, last_name, stage_name, dob, gender, nationality""",
)
def _(d):
    return R.actor_details({"actor": B.actor(d), "role": B.casting(d)}, AS_OF)


@query(
    "director_filmography",
    with_("gross", "film", "director")
    + f"""SELECT director_id, d.name, d.nationality, count(film_id) AS total_films,
  CAST(sum(budget) AS DECIMAL(25,2)) AS total_budget,
  CAST(sum(boxoffice_collection) AS DECIMAL(35,4)) AS total_boxoffice,
  {sql_ratio("sum(rating)", "count(rating)", 1, 7, 5)} AS avg_rating
FROM director d LEFT JOIN film ON fk_director_id = director_id GROUP BY director_id, d.name, d.nationality""",
)
def _(d):
    return R.director_filmography({"film": B.film(d), "director": B.director(d)})


@query(
    "director_portfolio",
    with_("gross", "film", "director")
    + """SELECT director_id, d.name, d.nationality, d.dob, count(film_id) AS films,
  CAST(sum(budget) AS DECIMAL(25,2)) AS total_budget,
  CAST(sum(boxoffice_collection) AS DECIMAL(35,4)) AS total_boxoffice
FROM director d LEFT JOIN film ON fk_director_id = director_id
GROUP BY director_id, d.name, d.nationality, d.dob""",
)
def _(d):
    return R.director_portfolio({"film": B.film(d), "director": B.director(d)})


@query(
    "producer_investment",
    f"""SELECT s_suppkey AS producer_id, s_name AS name, 'Company ' || s_nationkey AS company,
  count(DISTINCT l_orderkey) AS portfolio_films,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS total_investment,
  {sql_ratio("sum(CAST(l_extendedprice AS DECIMAL(15,2)))", "count(l_extendedprice)", 2, 19, 6)} AS avg_investment,
  max(CAST(l_extendedprice AS DECIMAL(15,2))) AS max_investment,
  min(CAST(l_extendedprice AS DECIMAL(15,2))) AS min_investment
FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name, s_nationkey""",
)
def _(d):
    return R.producer_investment({"producer": B.producer(d), "produced_by": B.produced_by(d)})


@query(
    "crew_by_department",
    with_("crew")
    + f"""SELECT department, count(DISTINCT crew_id) AS crew_count,
  {sql_ratio("sum(experience_years)", "count(experience_years)", 0, 14, 4)} AS avg_experience,
  max(experience_years) AS max_experience, count(DISTINCT o_orderkey) AS films_worked
FROM crew LEFT JOIN orders ON o_custkey = crew_id WHERE department IS NOT NULL GROUP BY department""",
)
def _(d):
    return R.crew_by_department({"crew": B.crew(d), "works_on": B.assignment(d)})


@query(
    "department_headcount",
    with_("crew")
    + f"""SELECT department, count(*) AS count,
  {sql_ratio("sum(experience_years)", "count(experience_years)", 0, 14, 4)} AS avg_exp
FROM crew WHERE department IS NOT NULL GROUP BY department""",
)
def _(d):
    return R.department_headcount({"crew": B.crew(d)})


@query(
    "crew_listing",
    with_("crew") + "SELECT crew_id, name, role, department, experience_years FROM crew",
)
def _(d):
    return R.crew_listing({"crew": B.crew(d)})


@query(
    "equipment_status",
    f"""SELECT p_partkey AS equipment_id, p_name AS name, p_type AS type,
  CAST(p_retailprice AS DECIMAL(12,2)) AS cost, p_brand AS availability, CAST(p_size AS VARCHAR) AS condition,
  count(DISTINCT l_orderkey) AS films_used,
  {sql_ratio("sum(CAST(l_discount AS DECIMAL(3,2)))", "count(l_discount)", 2, 7, 6)} AS avg_efficiency
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey
GROUP BY p_partkey, p_name, p_type, p_retailprice, p_brand, p_size""",
)
def _(d):
    return R.equipment_status({"equipment": B.equipment(d), "film_crew_equipment": B.booking(d)})


@query(
    "scene_filming_summary",
    """SELECT o_orderkey AS scene_id, c_custkey AS film_id, c_name AS film_title, o_orderpriority AS location,
  o_orderstatus AS description, CAST(dayofyear(o_orderdate) AS INTEGER) AS duration,
  count(DISTINCT l_suppkey) AS crew_involved, count(DISTINCT l_partkey) AS equipment_used,
  count(DISTINCT l_linenumber) AS filming_sessions
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_orderkey, c_custkey, c_name, o_orderpriority, o_orderstatus, o_orderdate""",
)
def _(d):
    return R.scene_filming_summary(scene_tables(d))


@query(
    "user_activity_summary",
    with_("account", "activity")
    + """SELECT a.username, full_name, role, count(DISTINCT log_id) AS total_activities,
  max("timestamp") AS last_activity,
  CAST(sum(CASE WHEN action_type = 'LOGIN_SUCCESS' THEN 1 ELSE 0 END) AS BIGINT) AS successful_logins,
  CAST(sum(CASE WHEN action_type = 'LOGIN_FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed_logins
FROM account a LEFT JOIN activity l ON l.username = a.username GROUP BY a.username, full_name, role""",
)
def _(d):
    return R.user_activity_summary({"user_metadata": B.account(d), "user_activity_log": B.activity(d)})


@query(
    "actor_filmography",
    with_("film_plain", "director")
    + """SELECT l_partkey AS actor_id, film_id, title, release_date, duration, language,
  l_returnflag AS character_name, CAST(l_quantity AS INTEGER) AS screen_time, l_linestatus AS importance,
  CAST(l_extendedprice AS DECIMAL(14,2)) AS salary, d.name AS director_name
FROM film_plain JOIN lineitem ON l_orderkey = film_id LEFT JOIN director d ON d.director_id = fk_director_id""",
)
def _(d):
    return R.actor_filmography({"role": B.line_role(d), "film": B.film_plain(d), "director": B.director(d)})


@query(
    "production_summary",
    with_("film_plain", "director")
    + """, a AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS actors, count(DISTINCT l_linenumber) AS scenes,
  count(DISTINCT l_suppkey) AS crew,
  count(DISTINCT CASE WHEN s_acctbal >= 5000 THEN l_suppkey END) AS places
  FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey)
SELECT film_id, title, production_status, budget, duration, d.name AS director,
  coalesce(actors, 0) AS total_actors, coalesce(scenes, 0) AS total_scenes, coalesce(crew, 0) AS total_crew,
  coalesce(places, 0) AS total_locations
FROM film_plain LEFT JOIN director d ON d.director_id = fk_director_id LEFT JOIN a ON l_orderkey = film_id""",
)
def _(d):
    return R.production_summary(production_tables(d))


@query(
    "crew_payroll",
    """WITH w AS (SELECT l_suppkey, l_orderkey, CAST(min(l_shipdate) AS DATE) AS start_date,
  CAST(max(l_shipdate) AS DATE) AS end_date FROM lineitem GROUP BY l_suppkey, l_orderkey),
s AS (SELECT * FROM lineitem WHERE l_returnflag = 'R')
SELECT w.l_orderkey AS film_id, s_suppkey AS crew_id, s_name AS name, 'Supplier' AS role,
  CAST(s_nationkey AS VARCHAR) AS department, start_date, end_date,
  CAST(end_date - start_date + 1 AS INTEGER) AS working_days, count(DISTINCT s.l_linenumber) AS shoots,
  CAST(sum(CAST(s.l_quantity AS INTEGER)) AS BIGINT) AS total_minutes
FROM supplier JOIN w ON w.l_suppkey = s_suppkey
LEFT JOIN s ON s.l_suppkey = s_suppkey AND s.l_orderkey = w.l_orderkey
GROUP BY w.l_orderkey, s_suppkey, s_name, s_nationkey, start_date, end_date""",
)
def _(d):
    shoots = B.shoot(d).where(F.col("notes") == "R")
    return R.crew_payroll({"crew": B.supplier_crew(d), "works_on": B.shipping_span(d), "scene_filming": shoots})


_EQUIPMENT = """p_partkey AS equipment_id, p_name AS name, p_type AS type,
  CAST(p_retailprice AS DECIMAL(12,2)) AS cost"""


@query(
    "equipment_usage",
    f"""WITH b AS (SELECT DISTINCT l_orderkey, l_partkey, CAST(l_quantity AS INTEGER) AS days_used,
  CAST(l_discount AS DECIMAL(3,2)) AS efficiency_rating, l_returnflag = 'R' AS maintenance_required FROM lineitem)
SELECT b.l_orderkey AS film_id, {_EQUIPMENT}, days_used, efficiency_rating, maintenance_required,
  count(DISTINCT s.l_linenumber) AS times_used, count(DISTINCT s.l_suppkey) AS crew_members_used
FROM part JOIN b ON b.l_partkey = p_partkey
LEFT JOIN lineitem s ON s.l_partkey = p_partkey AND s.l_orderkey = b.l_orderkey AND s.l_linestatus = 'F'
GROUP BY b.l_orderkey, p_partkey, p_name, p_type, p_retailprice, days_used, efficiency_rating,
  maintenance_required""",
)
def _(d):
    lines = d["lineitem"].where("l_linestatus = 'F'")
    shoots = B.shoot({"lineitem": lines})
    return R.equipment_usage(
        {"equipment": B.equipment(d), "film_crew_equipment": B.booking(d), "scene_filming": shoots}
    )


@query(
    "equipment_usage_null_film",
    f"""SELECT CAST(NULL AS BIGINT) AS film_id, {_EQUIPMENT}, CAST(NULL AS INTEGER) AS days_used,
  CAST(NULL AS DECIMAL(3,2)) AS efficiency_rating, CAST(NULL AS BOOLEAN) AS maintenance_required,
  CAST(0 AS BIGINT) AS times_used, CAST(0 AS BIGINT) AS crew_members_used FROM part""",
)
def _(d):
    tables = {"equipment": B.equipment(d), "film_crew_equipment": B.booking(d), "scene_filming": B.shoot(d)}
    return R.equipment_usage(tables, film_id=None)


@query(
    "boxoffice_analysis",
    with_("gross", "film", "film_money", "director")
    + """SELECT film_id, title, release_date, budget, boxoffice_collection, profit, roi_percentage,
  d.name AS director, count(DISTINCT l_partkey) AS cast_size
FROM film_money LEFT JOIN director d ON d.director_id = fk_director_id
LEFT JOIN lineitem ON l_orderkey = film_id WHERE boxoffice_collection > 0
GROUP BY film_id, title, release_date, budget, boxoffice_collection, profit, roi_percentage, d.name""",
)
def _(d):
    return R.boxoffice_analysis({"film": B.film(d), "director": B.director(d), "role": B.line_role(d)})


@query(
    "award_history",
    with_("actor")
    + """SELECT actor_id, first_name, last_name, nationality,
  CASE WHEN o_orderkey IS NOT NULL THEN 'Order ' || o_orderkey END AS award_name,
  CAST(year(o_orderdate) AS INTEGER) AS award_year, count(*) OVER (PARTITION BY actor_id) AS total_awards
FROM actor LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') o
  ON o_custkey = actor_id""",
)
def _(d):
    return R.award_history({"actor": B.actor(d), "actor_award": B.urgent_award(d)})


@query(
    "distributor_performance",
    with_("gross", "film")
    + f"""SELECT s_suppkey AS distributor_id, s_name AS name, 'Nation ' || s_nationkey AS region,
  CAST(s_nationkey AS DECIMAL(5,2)) AS market_share, count(DISTINCT l_orderkey) AS films_distributed,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS total_fees,
  {sql_ratio("sum(boxoffice_collection)", "count(boxoffice_collection)", 4, 29, 8)} AS avg_boxoffice
FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey LEFT JOIN film ON film_id = l_orderkey
GROUP BY s_suppkey, s_name, s_nationkey""",
)
def _(d):
    return R.distributor_performance(
        {"distributor": B.distributor(d), "distributes": B.distributes(d), "film": B.film(d)}
    )


@query(
    "kpi_totals",
    """SELECT (SELECT count(*) FROM orders) AS total_films, (SELECT count(*) FROM customer) AS total_actors,
  (SELECT CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(15,2))), 0) AS DECIMAL(25,2)) FROM orders) AS total_budget,
  (SELECT CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(5,2)))), 0)
     AS DECIMAL(35,4)) FROM lineitem) AS total_boxoffice""",
)
def _(d):
    # The box office of all films is the revenue of all lines, so one pass over the lines gives it.
    lines = d["lineitem"].select(B.line_revenue().cast("decimal(25,4)").alias("boxoffice_collection"))
    return R.kpi_totals({"film": B.film_plain(d), "actor": B.actor(d)}, lines)


@query(
    "status_distribution",
    "SELECT o_orderstatus AS production_status, count(*) AS count FROM orders GROUP BY o_orderstatus",
)
def _(d):
    return R.status_distribution({"film": B.film_plain(d)})


@query(
    "top_grossing",
    with_("gross", "film")
    + """SELECT title, boxoffice_collection FROM film WHERE boxoffice_collection > 0
ORDER BY boxoffice_collection DESC, film_id LIMIT 5""",
)
def _(d):
    return R.top_grossing({"film": B.film(d)})


@query(
    "film_listing",
    with_("gross", "film", "director")
    + """SELECT film_id, title, release_date, budget, boxoffice_collection, rating, production_status,
  d.name AS director FROM film LEFT JOIN director d ON d.director_id = fk_director_id""",
)
def _(d):
    return R.film_listing({"film": B.film(d), "director": B.director(d)})


@query(
    "director_films_with_profit",
    with_("gross", "film", "film_money")
    + """SELECT fk_director_id AS director_id, film_id, title, release_date, budget, boxoffice_collection, profit,
  roi_percentage, rating, production_status FROM film_money WHERE fk_director_id IS NOT NULL""",
)
def _(d):
    return R.director_films_with_profit({"film": B.film(d)})


@query(
    "directors_by_specialty",
    """SELECT o_orderpriority AS specialization, c_name AS name, CAST(count(*) AS INTEGER) AS years_experience,
  c_custkey AS director_id
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_orderpriority, c_name, c_custkey""",
)
def _(d):
    special = A.count_by(d["orders"], "o_custkey", "o_orderpriority").select(
        F.col("o_custkey").alias("director_id"),
        F.col("o_orderpriority").alias("specialization"),
        F.col("count").cast("int").alias("years_experience"),
    )
    return R.directors_by_specialty({"director_specialization": special, "director": B.director(d)})


@query(
    "director_awards",
    """SELECT c_name AS name, o_orderpriority AS award_name, CAST(year(o_orderdate) AS INTEGER) AS award_year
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'""",
)
def _(d):
    return R.director_awards({"director_award": B.finished_award(d), "director": B.director(d)})


@query(
    "availability_counts",
    "SELECT o_orderstatus AS availability, count(*) AS count FROM orders GROUP BY o_orderstatus",
)
def _(d):
    return R.availability_counts({"equipment": d["orders"].select(F.col("o_orderstatus").alias("availability"))})


@query(
    "cost_reconciliation",
    """WITH s AS (SELECT l_orderkey AS film_id, l_suppkey AS location_id, CAST(l_quantity AS INTEGER) AS days,
  CAST(s_acctbal AS DECIMAL(12,2)) AS cost_per_day, l_returnflag, CAST(l_extendedprice AS DECIMAL(15,2)) AS price
  FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey),
c AS (SELECT *, CAST(days * cost_per_day AS DECIMAL(15,2)) AS expected_cost,
  CASE l_returnflag WHEN 'A' THEN CAST(days * 1000 AS DECIMAL(15,2)) WHEN 'N' THEN price END AS total_cost FROM s)
SELECT film_id, location_id, days, cost_per_day, total_cost, expected_cost,
  CAST(total_cost - expected_cost AS DECIMAL(16,2)) AS difference
FROM c WHERE total_cost IS DISTINCT FROM expected_cost""",
)
def _(d):
    start = F.to_date("l_shipdate")
    shootings = d["lineitem"].select(
        F.col("l_orderkey").alias("film_id"),
        F.col("l_suppkey").alias("location_id"),
        start.alias("shooting_start"),
        F.date_add(start, F.col("l_quantity").cast("int") - 1).alias("shooting_end"),
        F.when(F.col("l_returnflag") == "A", (F.col("l_quantity").cast("int") * 1000).cast("decimal(15,2)"))
        .when(F.col("l_returnflag") == "N", B.dec("l_extendedprice", 15, 2))
        .alias("total_cost"),
    )
    places = d["supplier"].select(F.col("s_suppkey").alias("location_id"), B.dec("s_acctbal", 12, 2).alias("cost_per_day"))
    return R.cost_reconciliation({"shot_at": shootings, "shooting_location": places})


@query(
    "location_listing",
    with_("place") + "SELECT location_id, name, city, state, country, cost_per_day, area FROM place",
)
def _(d):
    return R.location_listing({"shooting_location": B.place(d)})


@query(
    "award_counts",
    """SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS actor_awards,
  (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS director_awards,
  (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS crew_awards""",
)
def _(d):
    return R.award_counts(
        {
            "actor_award": B.urgent_award(d),
            "director_award": B.finished_award(d),
            "crew_award": B.line_award(d, "crew_id", "l_suppkey"),
        }
    )


@query(
    "recent_awards",
    """SELECT 'Actor' AS type, c_mktsegment AS name, o_orderpriority AS award_name,
  CAST(year(o_orderdate) AS INTEGER) AS award_year
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'
UNION SELECT 'Director', s_name, l_linestatus, CAST(year(l_shipdate) AS INTEGER)
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R'
UNION SELECT 'Crew', p_name, l_linestatus, CAST(year(l_shipdate) AS INTEGER)
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'""",
)
def _(d):
    won = B.finished_award(d).withColumnRenamed("director_id", "actor_id")
    people = d["customer"].select(F.col("c_custkey").alias("actor_id"), F.col("c_mktsegment").alias("first_name"))
    return R.recent_awards(
        {
            "actor": people,
            "actor_award": won,
            "director": d["supplier"].select(F.col("s_suppkey").alias("director_id"), F.col("s_name").alias("name")),
            "director_award": B.line_award(d, "director_id", "l_suppkey"),
            "crew": d["part"].select(F.col("p_partkey").alias("crew_id"), F.col("p_name").alias("name")),
            "crew_award": B.line_award(d, "crew_id", "l_partkey"),
        }
    )


@query(
    "recent_activity",
    with_("activity")
    + """SELECT log_id, username, action_type, action_description,
  strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp" FROM activity a
ORDER BY a."timestamp" DESC, log_id LIMIT 100""",
)
def _(d):
    return R.recent_activity({"user_activity_log": B.activity(d)})


@query(
    "user_listing",
    with_("account")
    + """SELECT username, full_name, email, role, CASE WHEN is_active THEN 'Active' ELSE 'Inactive' END AS is_active,
  strftime(created_at, '%Y-%m-%d %H:%M') AS created_at, strftime(last_login, '%Y-%m-%d %H:%M') AS last_login,
  created_by FROM account""",
)
def _(d):
    return R.user_listing({"user_metadata": B.account(d)})


@query(
    "user_kpis",
    with_("account")
    + """SELECT count(*) AS total_users, count(*) FILTER (WHERE role = 'admin') AS administrators,
  count(*) FILTER (WHERE is_active) AS active_users FROM account""",
)
def _(d):
    return R.user_kpis({"user_metadata": B.account(d)})


@query("actor_details_preview", f"SELECT * FROM ({ORACLE['actor_details']}) ORDER BY actor_id LIMIT 10")
def _(d):
    return R.actor_details({"actor": B.actor(d), "role": B.casting(d)}, AS_OF, limit=10)


@query("actor_details_by_name", ORACLE["actor_details"])
def _(d):
    return R.actor_details({"actor": B.actor(d), "role": B.casting(d)}, AS_OF, ordered=True)


@query("equipment_status_preview", f"SELECT * FROM ({ORACLE['equipment_status']}) ORDER BY equipment_id LIMIT 10")
def _(d):
    return R.equipment_status({"equipment": B.equipment(d), "film_crew_equipment": B.booking(d)}, limit=10)


@query("user_activity_by_time", ORACLE["user_activity_summary"])
def _(d):
    return R.user_activity_summary({"user_metadata": B.account(d), "user_activity_log": B.activity(d)}, ordered=True)


@query("kpi_totals_by_film", ORACLE["kpi_totals"])
def _(d):
    return R.kpi_totals({"film": B.film(d), "actor": B.actor(d)})
