"""The lookup functions and one report as functions callable from SQL text.

They are native SQL functions: Catalyst inlines the body and turns a per-row lookup into
one left join over an aggregate. Parameters are always written with the function's name,
so that a column of the same name cannot take their place.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# Tables each function reads from, under the names of the production catalogue. Fixed
# values: the functions' names, and the texts and codes they return where nothing is found.
_FUNCTIONS = {
    "fn_calculate_film_profit": (
        ("film",),
        """(k BIGINT) RETURNS {profit} RETURN coalesce((
             SELECT max(coalesce(f.boxoffice_collection, 0) - coalesce(f.budget, 0))
             FROM film f WHERE f.film_id = fn_calculate_film_profit.k), 0)""",
    ),
    "fn_calculate_film_roi": (
        ("film",),
        """(k BIGINT) RETURNS DECIMAL(18,2) RETURN coalesce((
             SELECT max(CASE WHEN coalesce(f.budget, 1) > 0 THEN round(
               (coalesce(f.boxoffice_collection, 0) - coalesce(f.budget, 0)) * 100 / coalesce(f.budget, 1), 2)
               ELSE 0 END)
             FROM film f WHERE f.film_id = fn_calculate_film_roi.k), 0)""",
    ),
    "fn_get_actor_age": (
        ("actor",),
        """(k BIGINT, as_of DATE) RETURNS INT RETURN coalesce(
             year(fn_get_actor_age.as_of) - (SELECT max(year(a.dob)) FROM actor a
               WHERE a.actor_id = fn_get_actor_age.k), 0)""",
    ),
    "fn_director_film_count": (
        ("film",),
        """(k BIGINT) RETURNS BIGINT RETURN coalesce((SELECT count(*) FROM film f
             WHERE f.fk_director_id = fn_director_film_count.k), 0)""",
    ),
    "fn_producer_total_investment": (
        ("produced_by",),
        """(k BIGINT) RETURNS DECIMAL(25,2) RETURN coalesce((SELECT sum(b.investment) FROM produced_by b
             WHERE b.producer_id = fn_producer_total_investment.k), 0)""",
    ),
    "fn_film_total_crew_hours": (
        ("scene_filming",),
        """(k BIGINT) RETURNS BIGINT RETURN coalesce((SELECT sum(s.duration_minutes) FROM scene_filming s
             WHERE s.film_id = fn_film_total_crew_hours.k), 0)""",
    ),
    "fn_equipment_available": (
        ("equipment",),
        """(k BIGINT) RETURNS STRING RETURN coalesce((SELECT max(e.availability) FROM equipment e
             WHERE e.equipment_id = fn_equipment_available.k), 'Unknown')""",
    ),
    "fn_actor_screen_time": (
        ("role",),
        """(actor BIGINT, film BIGINT) RETURNS BIGINT RETURN coalesce((SELECT sum(r.screen_time) FROM role r
             WHERE r.actor_id = fn_actor_screen_time.actor AND r.film_id = fn_actor_screen_time.film), 0)""",
    ),
    "fn_film_total_scenes": (
        ("scene",),
        """(k BIGINT) RETURNS BIGINT RETURN coalesce((SELECT count(*) FROM scene s
             WHERE s.film_id = fn_film_total_scenes.k), 0)""",
    ),
    "fn_film_avg_actor_salary": (
        ("role",),
        """(k BIGINT) RETURNS DECIMAL(14,2) RETURN coalesce((SELECT avg(r.salary) FROM role r
             WHERE r.film_id = fn_film_avg_actor_salary.k), 0)""",
    ),
    "fn_authenticate_user": (
        ("user_metadata",),
        """(k STRING) RETURNS INT RETURN coalesce((
             SELECT max(CASE WHEN u.role IS NULL THEN -1 WHEN NOT u.is_active THEN -3 ELSE 1 END)
             FROM user_metadata u WHERE u.username = fn_authenticate_user.k), -1)""",
    ),
    "fn_director_films": (
        ("film",),
        """(k BIGINT) RETURNS TABLE (film_id BIGINT, release_date DATE, profit {profit}, roi_percentage DECIMAL(18,2))
           RETURN SELECT f.film_id, f.release_date,
             coalesce(f.boxoffice_collection, 0) - coalesce(f.budget, 0),
             CAST(CASE WHEN coalesce(f.budget, 1) > 0 THEN round(
               (coalesce(f.boxoffice_collection, 0) - coalesce(f.budget, 0)) * 100 / coalesce(f.budget, 1), 2)
               ELSE 0 END AS DECIMAL(18,2))
           FROM film f WHERE f.fk_director_id = fn_director_films.k""",
    ),
}


def register(
    spark: SparkSession, tables: Mapping[str, DataFrame], profit_type: str = "DECIMAL(26,4)", prefix: str = ""
) -> list[str]:
    """Create the functions whose tables are given, over temp views of those tables.

    Views and functions live in the session. With a ``prefix`` both bear it, so that callers
    over different tables don't replace each other's.
    """
    for name, frame in tables.items():
        frame.createOrReplaceTempView(f"{prefix}{name}")
    made = []
    for name, (needs, body) in _FUNCTIONS.items():
        if set(needs) <= set(tables):
            body = re.sub(r"\bfn_", f"{prefix}fn_", body.format(profit=profit_type))
            body = re.sub(r"\bFROM (\w+) ", rf"FROM {prefix}\1 ", body)
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}{body}")
            made.append(f"{prefix}{name}")
    return made
