import datetime as dt
import random

import compare
import duckdb
import pytest
from conftest import SMALL, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from callboard.operators import changes as C
from callboard.plans.catalog import ORACLE, QUERIES
from callboard.sources.model import TABLES, Ref, references
from callboard.sources.tables import load

# Inserts ---------------------------------------------------------------------------


def test_ids_continue_densely_in_the_order_of_the_key(spark):
    base = spark.createDataFrame([(7, "old")], "id int, name string")
    new = spark.range(1000).select(F.format_string("n%04d", 999 - F.col("id")).alias("name")).repartition(13)
    got = C.append_with_ids(base, new, "id", ["name"])
    found = sorted((r.id, r.name) for r in got.collect())
    assert found == [(7, "old")] + [(8 + i, f"n{i:04d}") for i in range(1000)]
    assert got.schema["id"].dataType.simpleString() == "int"


def test_ids_start_at_one_and_no_rows_are_fine(spark):
    base = spark.createDataFrame([], "id int, name string")
    new = spark.createDataFrame([("b",), ("a",)], "name string")
    assert rows(C.with_ids(base, new, "id", ["name"])) == [(1, "a"), (2, "b")]
    assert C.with_ids(base, new.where("false"), "id", ["name"]).count() == 0


def test_insert_ignore_keeps_old_rows_and_the_first_new_one(make):
    base = make([(1, "x", "old")], "id int, w string, o string")
    new = make([(1, "x", "new"), (2, "y", "b"), (2, "y", "a")], "id int, w string, o string")
    once = C.insert_ignore(base, new, ["id", "w"])
    assert rows(once) == [(1, "x", "old"), (2, "y", "a")]
    assert rows(C.insert_ignore(once, new, ["id", "w"])) == rows(once)


def test_insert_ignore_without_regard_to_case(make):
    base = make([(1, "Drama")], "id int, w string")
    new = make([(1, "drama"), (1, "Comedy"), (1, "COMÉDY")], "id int, w string")
    got = rows(C.insert_ignore(base, new, ["id", "w"], collation="UNICODE_CI_AI"))
    assert len(got) == 2 and got[1] == (1, "Drama") and got[0][1].lower() in ("comedy", "comédy")
    assert len(rows(C.insert_ignore(base, new, ["id", "w"]))) == 4


def test_defaults_fill_absent_columns_only(make):
    given = make([(1, "T", None)], "film_id int, title string, budget decimal(15,2)")
    now = dt.datetime(2024, 5, 6)
    row = C.fill_defaults(given, TABLES["film"], now).first()
    assert row.budget is None and row.rating is None and row.created_date == now
    assert (str(row.boxoffice_collection), row.production_status) == ("0.00", "Pre-Production")
    role = C.fill_defaults(make([(1, 1, 1)], "role_id int, actor_id int, film_id int"), TABLES["role"]).first()
    assert (role.importance, str(role.salary), role.screen_time) == ("Supporting", "0.00", None)


def test_assignment_copies_the_parent_attribute_and_needs_the_parent(seed, make):
    asked = make([(1, 3), (99, 3)], "crew_id int, film_id int")
    got = C.insert_select(asked, seed["crew"], {"crew_id": "crew_id"}, {"department": "department"})
    assert rows(got) == [(1, 3, "Camera")]


def test_film_with_genres(seed, make):
    new = make([("Zed", "Action, Drama,, drama "), ("Any", None)], "title string, genres string")
    films, genres = C.ingest_with_list(seed["film"], new, "film_id", ["title"], "genres", "genre",
                                       {"primary_genre": "Drama"}, collation="UNICODE_CI_AI")
    assert rows(films) == [(5, "Any", "Drama"), (6, "Zed", "Drama")]
    assert rows(genres) == [(6, "Action"), (6, "Drama")]


def test_location_with_cost(seed, make):
    asked = make(
        [(1, "A", "C", "X", "2024-01-01", None, "10"), (1, "B", "C", "X", "2024-01-01", "2024-01-03", "-1"),
         (1, "D", "C", "X", "2024-01-02", "2024-01-01", "1"), (2, "E", "C", "X", "2024-01-01", "2024-01-03", "2.50")],
        "film_id int, name string, city string, country string, shooting_start date, shooting_end date, "
        "cost_per_day decimal(12,2)",
    )
    places, shootings = C.ingest_location_cost(seed["shooting_location"], asked, ["name"])
    assert rows(places, "location_id", "name") == [(4, "A"), (5, "E")]
    assert rows(shootings, "film_id", "location_id", "total_days", "total_cost") == [(1, 4, 8, "80.00"), (2, 5, 3, "7.50")]


# Updates and audits ----------------------------------------------------------------


def test_updates_set_values_nulls_and_the_change_time(make):
    base = make([(1, "a", "x", "2020-01-01"), (2, "b", "y", "2020-01-01"), (3, "c", "z", "2020-01-01")],
                "id int, v string, w string, at date")
    updates = make([(1, None), (2, "b"), (9, "q")], "id int, v string")
    got = C.apply_updates(base, updates, ["id"], ["v"], "at", dt.date(2024, 1, 1))
    assert rows(got) == [(1, None, "x", "2024-01-01"), (2, "b", "y", "2020-01-01"), (3, "c", "z", "2020-01-01")]


def test_the_last_of_several_updates_wins(make):
    base = make([(1, "a"), (2, "b")], "id int, v string")
    updates = make([(1, 3, None), (1, 2, "y"), (1, 1, "z"), (2, 1, "q")], "id int, n int, v string")
    assert rows(C.apply_updates(base, updates, ["id"], ["v"], order_by=["n"])) == [(1, None), (2, "q")]


def test_audit_ignores_changes_from_and_to_null(make):
    old = make([(1, "a", 1), (2, None, 1), (3, "c", 1), (4, "d", 1)], "id int, s string, n int")
    new = make([(1, "b", 2), (2, "x", 1), (3, None, 1), (5, "e", 1)], "id int, s string, n int")
    got = C.audit_changes(old, new, ["id"], {"s": "STATUS_CHANGE", "n": "UPDATE"}, ["n"])
    assert rows(got) == [
        (1, "STATUS_CHANGE", "s", "a", "b", 1, 2), (1, "UPDATE", "n", "1", "2", 1, 2),
        (4, "DELETE", None, None, None, 1, None), (5, "INSERT", None, None, None, None, 1)]


def test_audit_replays_to_the_new_snapshot(spark):
    pick = random.Random(11)
    old = {i: pick.choice("abc") for i in range(300) if pick.random() < 0.8}
    new = {i: pick.choice("abc") for i in range(300) if pick.random() < 0.8}
    frames = [spark.createDataFrame(list(s.items()), "id int, v string") for s in (old, new)]
    replay = dict(old)
    for r in C.audit_changes(*frames, ["id"], {"v": "UPDATE"}, ["v"]).collect():
        if r.action == "DELETE":
            del replay[r.id]
        else:
            replay[r.id] = r.new_v
    assert replay == new


def windowed_changes(log):
    w = Window.partitionBy("k").orderBy("ts", "id")
    old = log.where("k IS NOT NULL").withColumn("old_value", F.lag("v").over(w))
    return old.where("old_value <> v").select("k", "ts", "id", "old_value", F.col("v").alias("new_value"))


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_log_audit_equals_a_window_on_a_hot_key(spark, partitions):
    pick = random.Random(partitions)
    data = [
        (None if i % 50 == 0 else 0 if i % 3 == 0 else pick.randrange(5000), pick.randrange(20), i, pick.choice(["a", "b", None]))
        for i in range(4000)
    ]
    log = spark.createDataFrame(data, "k int, ts int, id int, v string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = C.audit_from_log(log, "k", ["ts", "id"], "v")
        assert rows(got) == rows(windowed_changes(log))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_log_audit_of_nothing(spark):
    log = spark.createDataFrame([], "k int, ts int, id int, v string")
    assert C.audit_from_log(log, "k", ["ts", "id"], "v").count() == 0


def test_status_update_writes_one_or_two_rows(seed, make):
    updates = make([(3, "Released"), (1, "Released"), (77, "Released")], "film_id int, production_status string")
    args = (seed["film"], updates, "film_id", "production_status", "title", "budget")
    after, audit = C.status_update(*args)
    assert rows(after.where("production_status = 'Released'"), "film_id") == [(1,), (2,), (3,), (4,)]
    assert rows(audit, "film_id", "action", "old_status", "old_budget") == [
        (3, "STATUS_CHANGE", "Post-Production", "15000000.00")]
    _, both = C.status_update(*args, include_procedure_row=True)
    assert rows(both, "film_id", "action", "new_budget", "message") == [
        (1, "STATUS_UPDATE", None, "Film status updated from Released to Released"),
        (3, "STATUS_CHANGE", "15000000.00", "Film status updated from Post-Production to Released"),
        (3, "STATUS_UPDATE", None, "Film status updated from Post-Production to Released")]


# Deletes ---------------------------------------------------------------------------


def test_deleting_a_film_cascades_and_leaves_no_orphan(seed, make):
    left = C.delete_cascade(seed, "film", make([(1,)], "film_id int"), references(seed))
    counts = {n: left[n].count() for n in ("film", "role", "scene", "scene_filming", "works_on", "shot_at", "director", "actor")}
    assert counts == {"film": 3, "role": 2, "scene": 3, "scene_filming": 3, "works_on": 2, "shot_at": 2, "director": 4, "actor": 4}
    for child, ref in references(seed):
        parents = {r[0] for r in left[ref.table].select(ref.parent).collect()}
        used = {r[0] for r in left[child].select(ref.column).collect()} - {None}
        assert used <= parents, (child, ref.column)


def test_deleting_a_director_keeps_the_film_without_one(seed, make):
    left = C.delete_cascade(seed, "director", make([(4,)], "director_id int"), references(seed))
    assert rows(left["film"], "film_id", "fk_director_id") == [(1, 1), (2, 2), (3, 3), (4, None)]
    assert rows(left["director_award"], "director_id") == [(1,)]


def test_deleting_a_supervisor_clears_the_self_reference(seed, make):
    left = C.delete_cascade(seed, "crew", make([(1,)], "crew_id int"), references(seed))
    assert rows(left["crew"], "crew_id", "supervisor_id") == [(2, None), (3, None), (4, None)]
    assert rows(left["works_on"], "crew_id") == [(2,), (3,), (4,)]


def test_a_grandchild_reached_by_two_ways_is_deleted_once(make):
    tables = {
        "a": make([(1,), (2,)], "a int"),
        "b": make([(10, 1), (20, 2), (30, None)], "b int, a int"),
        "c": make([(100, 10, 2), (200, 20, 1), (300, 20, 2), (400, 30, None)], "c int, b int, a int"),
    }
    refs = [("b", Ref("a", "a", "a")), ("c", Ref("b", "b", "b")), ("c", Ref("a", "a", "a"))]
    left = C.delete_cascade(tables, "a", make([(1,)], "a int"), refs)
    assert rows(left["b"], "b") == [(20,), (30,)] and rows(left["c"], "c") == [(300,), (400,)]


# Accounts --------------------------------------------------------------------------


def outcomes(make, accounts, gone):
    frame = make(accounts, "username string, role string, is_active boolean")
    got = C.guarded_delete(frame, make([(g,) for g in gone], "username string"))
    return {r.username: r.outcome for r in got.collect()}


def test_the_last_active_administrator_stays(make):
    accounts = [("a", "admin", True), ("b", "admin", False), ("v", "viewer", True)]
    assert outcomes(make, accounts, ["a", "v"]) == {"a": "rejected", "b": "kept", "v": "rejected"}
    # An inactive administrator is protected too while only one active one exists.
    assert outcomes(make, accounts, ["b"])["b"] == "rejected"
    assert outcomes(make, accounts, ["v"]) == {"a": "kept", "b": "kept", "v": "deleted"}
    two = [("a", "admin", True), ("b", "admin", True)]
    assert outcomes(make, two, ["a"]) == {"a": "deleted", "b": "kept"}
    assert outcomes(make, two, ["a", "b"]) == {"a": "rejected", "b": "rejected"}


def test_login_rows_and_last_login(make):
    attempts = make([("a", True, "ip", "2024-01-02 00:00:00"), ("a", False, "ip", "2024-01-03 00:00:00"),
                     ("a", True, None, "2024-01-01 00:00:00")],
                    "username string, success boolean, ip_address string, timestamp timestamp_ntz")
    log = C.login_rows(attempts)
    assert rows(log, "action_type") == [("LOGIN_FAILED",), ("LOGIN_SUCCESS",), ("LOGIN_SUCCESS",)]
    accounts = make([("a", None), ("b", "2020-01-01 00:00:00")], "username string, last_login timestamp_ntz")
    assert rows(C.last_logins(accounts, log)) == [("a", "2024-01-02 00:00:00"), ("b", "2020-01-01 00:00:00")]


def test_account_log(make):
    old = make([("a", "viewer", True), ("b", None, True), ("z", "viewer", True)], "username string, role string, is_active boolean")
    new = make([("a", "admin", False), ("b", "admin", True), ("c", "manager", True)], "username string, role string, is_active boolean")
    assert rows(C.account_log_rows(old, new)) == [
        ("a", "USER_ROLE_CHANGE", "User a role changed from viewer to admin"),
        ("a", "USER_STATUS_CHANGE", "User a status changed to INACTIVE"),
        ("c", "USER_CREATED", "User c created with role manager")]


def _plain(old, new, **kw):
    args = (["k"], {"v": "UPDATE", "w": "CHANGE"})
    return rows(C.audit_changes(old, new, *args, **kw))


@pytest.mark.parametrize("kind", ["bigint", "date", "string"])
def test_pruned_audit_equals_the_whole_audit(spark, kind):
    shown = {"bigint": "id * 7 - 900", "date": "date_add(DATE'1960-01-01', CAST(id AS INT) * 3)", "string": "concat('k', id)"}[kind]
    base = spark.range(3000).selectExpr(f"{shown} AS k", "id % 5 AS v", "CAST(if(id % 3 = 0, NULL, id) AS STRING) AS w", "id")
    moved = F.col("id").between(700, 720) | (F.col("id") == 2999)
    old = base.where("id NOT IN (5, 1234)").drop("id")
    new = base.where("id <> 1500").withColumn("v", F.when(moved, F.col("v") + 1).otherwise(F.col("v")))
    new = new.withColumn("w", F.when(F.col("id") == 6, "now").when(F.col("id") == 7, F.lit(None)).otherwise(F.col("w"))).drop("id")
    whole = _plain(old, new)
    assert len(whole) == 3 + 22 and _plain(old, new, skip_equal=100) == whole == _plain(old, new, skip_equal=1)
    assert _plain(old, old, skip_equal=50) == [] == _plain(old.limit(0), old.limit(0), skip_equal=50)
    assert len(_plain(old.limit(0), new, skip_equal=50)) == new.count()


def test_pruned_audit_at_the_ends_of_the_key_and_with_nulls(spark):
    edge = [(-(2**63), 1, "a"), (2**63 - 1, 1, "a"), (0, 1, None), (None, 1, "a")]
    old = spark.createDataFrame(edge, "k bigint, v bigint, w string")
    new = spark.createDataFrame([(k, v + (k == 2**63 - 1), "a" if k == 0 else w) for k, v, w in edge], old.schema)
    assert _plain(old, new, skip_equal=10) == _plain(old, new) and len(_plain(old, new)) == 3
    swapped = spark.createDataFrame([(1, None, "a"), (2, 5, None)], old.schema), spark.createDataFrame([(1, 5, "a"), (2, None, None)], old.schema)
    assert C.unequal_ranges(*swapped, ["k"], ["v"], 1) is not None and _plain(*swapped, skip_equal=1) == _plain(*swapped)


def test_pruned_audit_reads_few_ranges_of_a_clustered_snapshot(spark, tmp_path):
    base = spark.range(20_000).selectExpr("id AS k", "id % 5 AS v", "'x' AS w")
    changed = base.withColumn("v", F.when(F.col("k").between(9_000, 9_040), 9).otherwise(F.col("v")))
    paths = [str(tmp_path / n) for n in ("old", "new")]
    for frame, path in zip((base, changed), paths):
        frame.repartitionByRange(4, "k").sortWithinPartitions("k").write.parquet(path)
    old, new = (spark.read.parquet(p) for p in paths)
    audit = C.audit_changes(old, new, ["k"], {"v": "UPDATE"}, skip_equal=1000)
    plan = audit._jdf.queryExecution().executedPlan().toString()
    assert plan.count("GreaterThanOrEqual(k,9000)") == 2 and plan.count("LessThanOrEqual(k,9059)") == 2
    # k % 5 makes none of them 9 before
    assert audit.count() == 41 == C.audit_changes(old, new, ["k"], {"v": "UPDATE"}).count()


def test_requests_of_one_name_are_turned_down_row_by_row(spark):
    accounts = spark.createDataFrame([("ann", "user")], "username string, role string")
    asked = [("bob", "user")] * 4 + [("bob", "admin"), ("ann", "x"), ("ann", "x"), (None, "y"), ("cy", None), ("cy", None)]
    after, rejected = C.create_accounts(accounts, spark.createDataFrame(asked, accounts.schema))
    assert rows(after) == [("ann", "user"), ("bob", "admin"), ("cy", None)]
    assert rows(rejected) == sorted([("bob", "user")] * 4 + [("ann", "x")] * 2 + [(None, "y"), ("cy", None)], key=repr)
    assert "Generate" not in rejected._jdf.queryExecution().executedPlan().toString()


def test_a_request_for_the_negative_of_key_zero_names_no_film(spark, tmp_path):
    tables = load(spark, SMALL, ["orders", "lineitem"])
    tables["orders"].where("o_orderkey < 3").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    # Every line of three films, once as a request for the film and once for its negative.
    asked = F.explode(F.array(F.lit(6), F.lit(7)))
    lines = tables["lineitem"].where("l_orderkey < 3").withColumn("l_linenumber", asked)
    assert lines.where("l_orderkey = 0").count() > 0
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    for name in ("orders", "lineitem"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("status_flow_rejected", "status_flow_result", "status_flow_audit"):
        assert compare.difference(QUERIES[name](spark, str(tmp_path)), db, ORACLE[name]) is None, name
