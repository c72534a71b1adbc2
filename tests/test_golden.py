"""Reports on the seed rows against results derived by hand."""

import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from callboard.functions import scalars as S
from callboard.operators import lookups as L
from callboard.plans import reports as R

AS_OF = dt.date(2024, 12, 31)


def test_film_profitability(seed):
    got = rows(R.film_profitability(seed), "film_id", "profit", "roi_percentage")
    assert got == [(1, "70000000.00", "140.00"), (2, "18000000.00", "150.00"), (4, "320000000.00", "400.00")]


def test_profitability_is_ordered_by_profit(seed):
    assert [r.film_id for r in R.film_profitability(seed).collect()] == [4, 1, 2]


def test_lookups_of_an_unreleased_and_an_unknown_film(seed, make):
    keys = make([(3,), (99,)], "film_id int")
    assert rows(L.film_profit(keys, seed["film"])) == [(3, "-15000000.00"), (99, "0.00")]
    assert rows(L.film_roi(keys, seed["film"])) == [(3, "-100.00"), (99, "0.00")]


def test_kpi_totals(seed):
    assert rows(R.kpi_totals(seed)) == [(4, 4, "157000000.00", "550000000.00")]


def test_status_distribution(seed):
    assert rows(R.status_distribution(seed)) == [("Post-Production", 1), ("Released", 3)]


def test_top_grossing(seed):
    got = [(r.title, int(r.boxoffice_collection)) for r in R.top_grossing(seed).collect()]
    assert got == [("Desert Horizon", 400000000), ("Quantum Dreams", 120000000), ("Tiny Stories", 30000000)]


def test_director_filmography(seed):
    assert rows(R.director_filmography(seed), "name", "total_films", "total_budget", "total_boxoffice", "avg_rating") == [
        ("Ava DuVernay", 1, "15000000.00", "0.00", None),
        ("Christopher Nolan", 1, "50000000.00", "120000000.00", "8.20000"),
        ("Denis Villeneuve", 1, "80000000.00", "400000000.00", "9.00000"),
        ("Greta Gerwig", 1, "12000000.00", "30000000.00", "7.10000"),
    ]


def test_producer_investment(seed):
    got = R.producer_investment(seed).select(
        "name", "portfolio_films", *[F.col(c).cast("int") for c in (
            "total_investment", "avg_investment", "max_investment", "min_investment")])
    assert [tuple(r) for r in got.collect()] == [
        ("Emma Thomas", 2, 55000000, 27500000, 30000000, 25000000),
        ("Dede Gardner", 2, 35000000, 17500000, 25000000, 10000000),
        ("Scott Rudin", 2, 23000000, 11500000, 15000000, 8000000),
    ]


def test_distributor_performance(seed):
    got = R.distributor_performance(seed).select(
        "name", "films_distributed", F.col("total_fees").cast("int"), F.col("avg_boxoffice").cast("int")
    )
    assert [tuple(r) for r in got.collect()] == [
        ("Sony Pictures", 1, 50000000, 400000000),
        ("Warner Distribution", 1, 40000000, 120000000),
        ("Universal Pictures", 1, 0, 120000000),
    ]


def test_production_summary(seed):
    columns = ["film_id", "total_actors", "total_scenes", "total_crew", "total_locations"]
    assert rows(R.production_summary(seed), *columns) == [(1, 2, 2, 3, 2), (2, 1, 1, 0, 0), (3, 0, 0, 0, 0), (4, 1, 2, 2, 2)]
    assert rows(R.production_summary(seed, key=4), *columns) == [(4, 1, 2, 2, 2)]


def test_crew_by_department(seed):
    assert rows(R.crew_by_department(seed)) == [
        ("Camera", 1, "15.0000", 15, 2),
        ("Editing", 1, "8.0000", 8, 1),
        ("Lighting", 1, "12.0000", 12, 1),
        ("Sound", 1, "18.0000", 18, 1),
    ]


def test_equipment_status(seed):
    assert rows(R.equipment_status(seed), "equipment_id", "films_used", "avg_efficiency") == [
        (1, 1, "9.10000"), (2, 1, "8.80000"), (3, 1, "8.00000"), (4, 0, None)]


def test_scene_filming_summary(seed):
    got = rows(R.scene_filming_summary(seed), "scene_id", "crew_involved", "equipment_used", "filming_sessions")
    assert got == [(i, 1, 1, 1) for i in range(1, 6)]


def test_crew_payroll(seed):
    columns = ["film_id", "crew_id", "working_days", "shoots", "total_minutes"]
    film_1 = [(1, 1, 137, 1, 480), (1, 2, 121, 1, 360), (1, 3, 93, 0, None)]
    film_4 = [(4, 1, 178, 1, 1200), (4, 4, 136, 1, 480)]
    assert rows(R.crew_payroll(seed), *columns) == film_1 + film_4
    assert rows(R.crew_payroll(seed, key=4), *columns) == film_4


def test_equipment_usage_of_one_film_of_all_and_of_null(seed):
    columns = ["film_id", "name", "days_used", "efficiency_rating", "maintenance_required", "times_used", "crew_members_used"]
    film_1 = [(1, "Arri Alexa Mini", 45, "9.1", False, 1, 1), (1, "Dolly Track Set", 20, "8.0", False, 1, 1)]
    film_4 = [(4, "RED Helium", 60, "8.8", True, 1, 1)]
    assert rows(R.equipment_usage(seed, 1), *columns) == film_1
    assert rows(R.equipment_usage(seed, 4), *columns) == film_4
    assert rows(R.equipment_usage(seed), *columns) == film_1 + film_4
    nothing = rows(R.equipment_usage(seed, None), *columns)
    assert len(nothing) == 4 and all(r[0] is None and r[2:] == (None, None, None, 0, 0) for r in nothing)


def test_award_history_counts_one_for_an_actor_without_awards(seed):
    assert rows(R.award_history(seed), "actor_id", "award_name", "total_awards") == [
        (1, "Best Actor - Sci-Fi Fest", 1), (2, None, 1), (3, "Best Supporting Actor", 1), (4, None, 1)]


def test_recent_awards(seed):
    got = [(r.award_year, r.type, r.name) for r in R.recent_awards(seed).collect()]
    assert got == [
        (2024, "Actor", "Leonardo"), (2024, "Crew", "Sam Carter"), (2023, "Director", "Christopher Nolan"),
        (2022, "Director", "Denis Villeneuve"), (2021, "Crew", "Priya Patel"), (2020, "Actor", "Robert")]


def test_award_counts(seed):
    assert rows(R.award_counts(seed)) == [(2, 2, 2)]


def test_inclusive_days_and_cost_against_the_stored_cost(seed):
    stays = seed["shot_at"].join(seed["shooting_location"], "location_id")
    days = S.inclusive_days("shooting_start", "shooting_end")
    cost = S.stay_cost("shooting_start", "shooting_end", "cost_per_day").cast("int")
    got = rows(stays.select("film_id", "location_id", days, cost, F.col("total_cost").cast("int")))
    assert got == [
        (1, 1, 17, 42500, 200000), (1, 2, 11, 38500, 150000), (4, 2, 44, 154000, 800000), (4, 3, 21, 105000, 300000)]


def test_user_reports(seed):
    assert rows(R.user_activity_summary(seed)) == [("admin", "System Administrator", "admin", 0, None, 0, 0)]
    assert rows(R.user_kpis(seed)) == [(1, 1, 1)]
    listed = R.user_listing(seed).first()
    assert (listed.is_active, listed.created_at, listed.last_login) == ("Active", "2024-12-31 12:00", None)


def test_investment_is_summed_per_producer(seed, make):
    keys = make([(1,), (9,)], "producer_id int")
    got = L.child_sum(keys, seed["produced_by"], {"producer_id": "producer_id"}, "investment", "total")
    assert rows(got) == [(1, "55000000.00"), (9, "0.00")]


def test_listings(seed):
    assert [r.title for r in R.film_listing(seed).collect()] == [
        "Echoes of Home", "Desert Horizon", "Quantum Dreams", "Tiny Stories"]
    assert [r.name for r in R.crew_listing(seed).collect()] == ["Sam Carter", "Priya Patel", "Alex Kim", "Miguel Sanchez"]
    assert [r.city for r in R.location_listing(seed).collect()] == ["Detroit", "New York", "Santa Monica"]
    assert [(r.specialization, r.name) for r in R.directors_by_specialty(seed).collect()][-2:] == [
        ("Thriller", "Christopher Nolan"), ("Thriller", "Denis Villeneuve")]
    assert [r.award_year for r in R.director_awards(seed).collect()] == [2023, 2022]
    assert rows(R.availability_counts(seed)) == [("Available", 3), ("In Use", 1)]
    assert rows(R.department_headcount(seed), "department", "count") == [
        ("Camera", 1), ("Editing", 1), ("Lighting", 1), ("Sound", 1)]


def test_actor_reports(seed):
    assert rows(R.actor_details(seed, AS_OF), "full_name", "age", "total_films") == [
        ("Emma Stone", 36, 1), ("Leonardo DiCaprio", 50, 1), ("Robert Downey Jr.", 59, 1), ("Tessa Thompson", 41, 1)]
    assert rows(R.actor_filmography(seed, key=3), "title", "character_name", "director_name") == [
        ("Quantum Dreams", "Engineer Mark", "Christopher Nolan")]
    assert rows(R.director_portfolio(seed), "name", "films")[0] == ("Ava DuVernay", 1)
    assert rows(R.director_films_with_profit(seed, key=4), "film_id", "roi_percentage") == [(4, "400.00")]


def test_preview_is_capped_and_the_view_is_not(seed):
    assert [r.film_id for r in R.film_basic(seed, limit=2).collect()] == [1, 2]
    assert R.film_basic(seed).count() == 4


def test_every_report_is_in_the_catalogue():
    assert len(R.REPORTS) == 34 and R.REPORTS["kpi_totals"] is R.kpi_totals


def test_stored_shooting_costs_are_reconciled(seed):
    found = {(r["film_id"], r["location_id"]): r for r in R.cost_reconciliation(seed).collect()}
    assert set(found) == {(1, 1), (1, 2), (4, 2), (4, 3)}
    first = found[1, 1]
    assert (first["days"], str(first["total_cost"]), str(first["expected_cost"]), str(first["difference"])) == (17, "200000.00", "42500.00", "157500.00")
    assert R.cost_reconciliation(seed, key=4).count() == 2


def test_status_updates_keep_columns_named_like_the_films(spark, seed):
    from callboard.operators import flows
    from callboard.sources.model import TABLES

    log = spark.createDataFrame([], TABLES["film_audit"].schema())
    asked = spark.createDataFrame([(1, "Archived", "mine", 7), (77, "Released", "none", 8)], "film_id int, production_status string, budget string, _k int")
    done = flows.set_film_status(seed["film"], log, asked, dt.datetime(2024, 12, 31))
    assert rows(done.rejected, "film_id", "budget", "_k") == [(77, "none", 8)]
    after = {r["film_id"]: r["production_status"] for r in done.tables["film"].collect()}
    assert after[1] == "Archived" and done.tables["film_audit"].count() == 2
