import datetime as dt

import pytest
from conftest import SMALL, rows

from callboard import session
from callboard.functions import sqlfns
from callboard.operators import quality as Q
from callboard.plans import views
from callboard.sources import model, sinks, tables, working


def test_append_and_snapshots_round_trip(spark, make, tmp_path):
    first, second = make([(1, "a")], "id int, v string"), make([(2, "b")], "id int, v string")
    path = str(tmp_path / "log")
    sinks.append(first, path)
    sinks.append(second, path)
    assert rows(spark.read.parquet(path)) == [(1, "a"), (2, "b")]

    root = str(tmp_path / "table")
    assert sinks.current_version(spark, root) == 0
    with pytest.raises(FileNotFoundError):
        sinks.read_snapshot(spark, root)
    sinks.write_snapshot(first, root)
    sinks.write_snapshot(second, root, cluster_by=("id",))
    assert rows(sinks.read_snapshot(spark, root)) == [(2, "b")]
    assert rows(sinks.read_snapshot(spark, root, version=1)) == [(1, "a")]


def test_a_crash_before_the_commit_blocks_nothing(spark, make, tmp_path):
    root = str(tmp_path / "table")
    sinks.write_snapshot(make([(1,)], "id int"), root)
    make([(2,)], "id int").write.parquet(f"{root}/data-lost")
    assert rows(sinks.read_snapshot(spark, root)) == [(1,)]
    (tmp_path / "table/manifest/000000002").write_text("data-lo")  # an entry that was never finished
    assert sinks.current_version(spark, root) == 1
    sinks.write_snapshot(make([(3,)], "id int"), root)
    assert rows(sinks.read_snapshot(spark, root)) == [(3,)] and sinks.current_version(spark, root) == 3
    with pytest.raises(FileNotFoundError):
        sinks.read_snapshot(spark, root, version=2)


def test_of_two_writers_of_one_version_one_wins(spark, make, tmp_path):
    root = str(tmp_path / "table")
    for name, row in (("data-a", 1), ("data-b", 2)):
        make([(row,)], "id int").write.parquet(f"{root}/{name}")
    sinks.commit(spark, root, 1, "data-a")
    with pytest.raises(sinks.VersionTaken):
        sinks.commit(spark, root, 1, "data-b")
    assert rows(sinks.read_snapshot(spark, root)) == [(1,)]


def test_working_tables_are_released(spark, make):
    df = make([(1, "a")], "id int, v string")
    with working.dropped_after(spark):
        kept = working.folder(spark, "test")
        assert rows(working.written(df, kept)) == [(1, "a")]
    assert working.children(spark, kept) == []
    kept = working.folder(spark, "test")
    working.written(df, kept)
    assert working.children(spark, kept)
    working.release(spark)
    assert working.children(spark, kept) == []


def test_split_is_written_in_one_table(spark, make, tmp_path):
    df = make([(1, "5"), (2, "-5")], "id int, x decimal(5,2)")
    path = str(tmp_path / "split")
    sinks.write_split(Q.check(df, [Q.at_least("x", 0)]), path)
    valid, bad = sinks.read_split(spark, path)
    assert rows(valid) == [(1, "5.00")] and rows(bad, "id") == [(2,)]
    assert "PartitionFilters: [isnotnull(is_valid" in valid._jdf.queryExecution().toString()


def test_catalogue_loads_with_declared_types(spark, seed, tmp_path):
    seed["film"].write.parquet(str(tmp_path / "film"))
    film = model.load_catalogue(spark, str(tmp_path), ["film"])["film"]
    assert dict(film.dtypes)["budget"] == "decimal(15,2)" and film.count() == 4


def test_parameters_are_bound_not_spliced(spark, make):
    df = make([(1, "a' OR '1'='1"), (2, "b")], "id int, v string")
    got = tables.sql(spark, "SELECT id FROM {t} WHERE v = :v", {"t": df}, v="a' OR '1'='1")
    assert rows(got) == [(1,)]
    tables.register_views({"some_view": df})
    assert rows(tables.sql(spark, "SELECT v FROM some_view WHERE id = :id", id=2)) == [("b",)]


def test_loading_reads_only_the_columns_and_row_groups_needed(spark):
    orders = tables.load(spark, SMALL, ["orders"])["orders"]
    plan = orders.where("o_orderkey = 5").select("o_custkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,5)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_sql_functions_equal_the_bulk_lookups(spark, seed):
    made = sqlfns.register(spark, seed, profit_type="DECIMAL(16,2)")
    assert len(made) == 12
    got = spark.sql(
        """SELECT k, fn_calculate_film_profit(k), fn_calculate_film_roi(k), fn_film_total_crew_hours(k),
             fn_film_total_scenes(k), fn_film_avg_actor_salary(k), fn_director_film_count(k),
             fn_producer_total_investment(k), fn_equipment_available(k), fn_get_actor_age(k, DATE '2024-12-31'),
             fn_actor_screen_time(k, k)
           FROM VALUES (1), (2), (99) t(k)"""
    )
    assert rows(got) == [
        (1, "70000000.00", "140.00", 840, 2, "1400000.00", 1, "55000000.00", "Available", 50, 40),
        (2, "18000000.00", "150.00", 120, 1, "450000.00", 1, "23000000.00", "In Use", 36, 50),
        (99, "0.00", "0.00", 0, 0, "0.00", 0, "0.00", "Unknown", 0, 0),
    ]
    users = spark.sql("SELECT u, fn_authenticate_user(u) FROM VALUES ('admin'), ('nobody') t(u)")
    assert rows(users) == [("admin", 1), ("nobody", -1)]
    films = spark.sql("SELECT film_id, profit FROM fn_director_films(4)")
    assert rows(films) == [(4, "320000000.00")]


def test_reports_are_there_as_views_and_procedures(spark, seed):
    assert len(views.register_views(seed, dt.date(2024, 12, 31))) == 9
    got = spark.sql("SELECT film_id, director FROM view_film_profitability WHERE roi_percentage > 145")
    assert rows(got) == [(2, "Greta Gerwig"), (4, "Denis Villeneuve")]
    assert spark.sql("SELECT age FROM view_actor_details WHERE actor_id = 1").first().age == 50
    assert "max_investment" not in spark.table("view_producer_investment").columns
    for name in views.VIEWS:
        assert "rangepartitioning" not in spark.table(name)._jdf.queryExecution().toString()
    one = views.PROCEDURES["sp_calculate_producer_investment"](seed, 1)
    assert rows(one, "total_films", "max_investment") == [(2, "30000000.00")]
    assert views.PROCEDURES["sp_get_equipment_usage_report"](seed, None).count() == 4


def test_session_settings_of_the_cluster_stay(spark):
    folder = session.shared_folder(spark)
    assert folder == session.shared_folder(spark)
    assert session.tune(spark).conf.get("spark.sql.adaptive.enabled") == "true"
