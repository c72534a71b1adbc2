"""Reports under the view and procedure names that existing SQL and callers use."""

from __future__ import annotations

import datetime as dt
import inspect
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from callboard.operators import changes as C
from callboard.operators import flows
from callboard.plans import reports as R

# View names. The reporting date decides ages.
VIEWS: dict[str, Callable[[Mapping[str, DataFrame], dt.date], DataFrame]] = {
    "view_film_basic": lambda t, as_of: R.film_basic(t),
    "view_film_profitability": lambda t, as_of: R.film_profitability(t, ordered=False),
    "view_actor_details": lambda t, as_of: R.actor_details(t, as_of),
    "view_director_filmography": lambda t, as_of: R.director_filmography(t),
    "view_producer_investment": lambda t, as_of: R.producer_investment(t, ordered=False).drop(
        "max_investment", "min_investment"
    ),
    "view_crew_by_department": lambda t, as_of: R.crew_by_department(t),
    "view_equipment_status": lambda t, as_of: R.equipment_status(t),
    "view_scene_filming_summary": lambda t, as_of: R.scene_filming_summary(t),
    "view_user_activity_summary": lambda t, as_of: R.user_activity_summary(t),
}

# Procedure names. Each takes the tables and, where there was one, the id.
PROCEDURES: dict[str, Callable[..., DataFrame]] = {
    "sp_get_actor_filmography": R.actor_filmography,
    "sp_calculate_producer_investment": lambda t, key=None, ordered=True: R.producer_investment(
        t, key, ordered
    ).withColumnRenamed("portfolio_films", "total_films"),
    "sp_get_film_production_summary": R.production_summary,
    "sp_get_director_filmography_with_profit": R.director_films_with_profit,
    "sp_get_film_crew_payroll": R.crew_payroll,
    "sp_get_equipment_usage_report": R.equipment_usage,
    "sp_get_boxoffice_analysis": R.boxoffice_analysis,
    "sp_get_actor_award_history": R.award_history,
    "sp_get_distributor_performance": R.distributor_performance,
    "sp_get_all_users": R.user_listing,
}

# Names of the writing procedures, as bulk forms over tables and requests.
WRITES: dict[str, Callable] = {
    "sp_add_film_with_genres": flows.add_films,
    "sp_allocate_crew_to_film": C.insert_select,
    "sp_cast_actor_in_film": flows.add_roles,
    "sp_update_equipment_status": flows.set_equipment_status,
    "sp_add_shooting_location": C.ingest_location_cost,
    "sp_update_film_status": flows.set_film_status,
    "sp_create_user": C.create_accounts,
    "sp_update_login": C.last_logins,
    "sp_update_user_status": C.guarded_deactivate,
    "sp_delete_user": C.guarded_delete,
}


# The key of the procedures that take one. Where the argument is NULL no row comes;
# ``reports.equipment_usage`` has the form for a NULL film.
KEYS = {
    "sp_get_actor_filmography": "actor_id",
    "sp_calculate_producer_investment": "producer_id",
    "sp_get_film_production_summary": "film_id",
    "sp_get_director_filmography_with_profit": "director_id",
    "sp_get_film_crew_payroll": "film_id",
    "sp_get_equipment_usage_report": "film_id",
    "sp_get_boxoffice_analysis": None,
    "sp_get_actor_award_history": "actor_id",
    "sp_get_distributor_performance": None,
    "sp_get_all_users": None,
}


def register_procedures(spark: SparkSession, tables: Mapping[str, DataFrame], names: Sequence[str], prefix: str = "") -> None:
    """The named report procedures as SQL table functions of their key.

    ``SELECT r.* FROM films f, LATERAL sp_get_film_crew_payroll(f.film_id) r`` reads the
    report for many keys in one join: a function is a filter on the unordered report, so
    Catalyst inlines it and turns the argument into a join key, or into a pushed filter where
    it is a constant. Views and functions bear the ``prefix`` and live in the session.
    """
    for name in names:
        report, key = PROCEDURES[name], KEYS[name]
        unordered = {"ordered": False} if "ordered" in inspect.signature(report).parameters else {}
        rows = report(tables, **unordered)
        rows.createOrReplaceTempView(f"{prefix}{name}_rows")
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        columns = ", ".join(f"{c} {k}" for c, k in kinds.items())
        shown = ", ".join(f"v.{c}" for c in kinds)
        where = f" WHERE v.{key} = {prefix}{name}.k" if key else ""
        argument = f"k {kinds[key]}" if key else ""
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({argument}) RETURNS TABLE ({columns}) "
            f"RETURN SELECT {shown} FROM {prefix}{name}_rows v{where}"
        )


def register_views(tables: Mapping[str, DataFrame], as_of: dt.date) -> list[str]:
    """Temp views over the reports. A view is planned when it is read, never stored."""
    for name, build in VIEWS.items():
        build(tables, as_of).createOrReplaceTempView(name)
    return list(VIEWS)
