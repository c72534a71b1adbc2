"""Streaming jobs over several small batches against their batch forms."""

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from callboard.operators import changes as C
from callboard.operators import quality as Q
from callboard.plans import bindings as B
from callboard.plans import reports as R
from callboard.plans.queries_quality import event_rules
from callboard.sources import sinks
from callboard.sources.tables import DRIVER_SCHEMAS, load
from callboard.streaming import jobs


@pytest.fixture
def feed(spark, tmp_path):
    """The events as five files that arrive in time order, and the whole table."""
    events = load(spark, SMALL, ["events"])["events"]
    folder = str(tmp_path / "feed")
    for i in range(5):
        day = F.dayofmonth("ts")
        part = events.where((day > i * 7) & (day <= i * 7 + 7)).coalesce(1)
        part.write.mode("append").parquet(folder)
    return jobs.read_files(spark, folder, DRIVER_SCHEMAS["events"], files_per_batch=1), events


def test_quarantine_equals_batch_validation(spark, feed, tmp_path):
    stream, events = feed
    out = str(tmp_path / "out")
    jobs.quarantine(stream, event_rules(), out, str(tmp_path / "ckpt")).awaitTermination()
    stored_valid, stored_bad = sinks.read_split(spark, out)
    valid, bad = Q.validate(events, event_rules())
    assert rows(stored_valid, *events.columns) == rows(valid)
    assert rows(stored_bad, "event_id", "violations") == rows(bad, "event_id", "violations")


def test_quarantine_with_a_parent_table(spark, feed, tmp_path):
    stream, events = feed
    parents = {"users": events.where("user_id > 5").select("user_id").distinct()}
    rule = Q.Reference("fk", "No such user", ("user_id",), "users", ("user_id",))
    out = str(tmp_path / "out")
    jobs.quarantine(stream, [rule], out, str(tmp_path / "ckpt"), parents).awaitTermination()
    assert sinks.read_split(spark, out)[1].count() == events.where("user_id <= 5").count()


def test_running_summary_equals_the_batch_report(spark, feed, tmp_path):
    stream, events = feed
    out = str(tmp_path / "out")
    measures = R.activity_measures()
    jobs.running_summary(
        B.activity({"events": stream}), "username", measures, out, str(tmp_path / "ckpt")
    ).awaitTermination()
    batch = B.activity({"events": events}).groupBy("username").agg(*[m.alias(n) for n, m in measures.items()])
    latest = jobs.latest_summary(spark, out, "username")
    assert rows(latest, *batch.columns) == rows(batch)


def test_change_audit_equals_the_batch_audit(spark, feed, tmp_path):
    stream, events = feed
    out = str(tmp_path / "out")
    args = ("user_id", ["ts", "event_id"], "event_type")
    jobs.change_audit(stream, *args, out, str(tmp_path / "ckpt")).awaitTermination()
    assert rows(jobs.read_changes(spark, out)) == rows(C.audit_from_log(events, *args))


def test_change_audit_goes_on_after_a_restart(spark, feed, tmp_path):
    _, events = feed
    folder, out, ckpt = (str(tmp_path / n) for n in ("late", "out", "ckpt"))
    args = ("user_id", ["ts", "event_id"], "event_type")
    for part in (events.where("day(ts) <= 10"), events.where("day(ts) > 10")):
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.read_files(spark, folder, DRIVER_SCHEMAS["events"])
        jobs.change_audit(stream, *args, out, ckpt).awaitTermination()
    assert rows(jobs.read_changes(spark, out)) == rows(C.audit_from_log(events, *args))


def _of_days(spark, events, folder, *spans):
    for low, high in spans:
        events.where(f"day(ts) BETWEEN {low} AND {high}").coalesce(1).write.mode("append").parquet(folder)
    return jobs.read_files(spark, folder, DRIVER_SCHEMAS["events"], files_per_batch=1)


def test_summary_batches_write_their_own_keys_only(spark, tmp_path):
    folder, out = str(tmp_path / "feed"), str(tmp_path / "out")
    for number, keys in enumerate(([1, 2, 3, 4, 4], [2], [3, 3, 5])):
        part = spark.createDataFrame([(k, number) for k in keys], "k bigint, epoch int")
        part.coalesce(1).write.mode("append").parquet(folder)
        rows_ = jobs.read_files(spark, folder, "k bigint, epoch int")
        jobs.running_summary(rows_, "k", {"n": F.count("*"), "epoch": F.max("epoch")}, out, str(tmp_path / "c")).awaitTermination()
    written = spark.read.parquet(out).groupBy("epoch").count()
    assert rows(written) == [(0, 4), (1, 1), (2, 2)]
    assert rows(jobs.latest_summary(spark, out, "k")) == [(1, 1, 0), (2, 2, 1), (3, 3, 2), (4, 2, 0), (5, 1, 2)]
    # A batch that is repeated overwrites its own rows.
    spark.createDataFrame([((3, 3, 2),), ((5, 1, 2),)], "totals struct<k bigint, n bigint, epoch int>").write.mode("overwrite").parquet(f"{out}/epoch=2")
    assert jobs.latest_summary(spark, out, "k").count() == 5


def test_change_audit_of_whole_numbers_with_nulls(spark, tmp_path):
    schema = "k bigint, t bigint, v bigint, note string"
    big = 2**60
    history = [(1, 1, big), (1, 2, None), (1, 3, big + 1), (1, 4, big + 2), (2, 1, 5), (None, 1, 1), (None, 2, 2), (2, 2, 5)]
    later = [(1, 5, big + 2), (1, 6, 7), (2, 4, 6), (2, 3, 5), (3, 9, 1)]
    for part in (history, later):
        frame = spark.createDataFrame([(*r, "n") for r in part], schema)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        stream = jobs.read_files(spark, str(tmp_path / "feed"), schema)
        jobs.change_audit(stream, "k", ["t"], "v", str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    found = rows(jobs.read_changes(spark, str(tmp_path / "out")))
    assert found == [(1, 4, big + 1, big + 2), (1, 6, big + 2, 7), (2, 4, 5, 6)]
    whole = spark.createDataFrame([(*r, "n") for r in history + later], schema)
    assert found == rows(C.audit_from_log(whole, "k", ["t"], "v"))


KEY = Q.Unique("once", "Seen before", ("user_id", "event_type"))


def _later_copies(events):
    first = events.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("m"))
    joined = events.join(first, ["user_id", "event_type"])
    return joined.where(F.struct("ts", "event_id") != F.col("m")).select("event_id")


def test_key_rule_on_arrival_across_batches_and_a_restart(spark, tmp_path):
    events = load(spark, SMALL, ["events"])["events"]
    folder, out, ckpt = (str(tmp_path / n) for n in ("feed", "out", "ckpt"))
    for spans in ([(1, 3), (4, 12)], [(13, 20), (21, 31)]):
        stream = _of_days(spark, events, folder, *spans)
        rules = [KEY, *event_rules()]
        jobs.quarantine(stream, rules, out, ckpt, order_by=["ts", "event_id"]).awaitTermination()
    valid, bad = sinks.read_split(spark, out)
    copies = bad.where(F.exists("violations", lambda v: v["rule_id"] == "once"))
    assert rows(copies, "event_id") == rows(_later_copies(events)) and copies.where("violations[0].message IS NULL").count() == 0
    assert valid.count() + bad.count() == events.count() and valid.columns == events.columns
    plain = Q.validate(events, event_rules())[1]
    others = bad.select("event_id", F.filter("violations", lambda v: v["rule_id"] != "once").alias("violations"))
    assert rows(others.where("size(violations) > 0")) == rows(plain, "event_id", "violations")


def test_key_rule_leaves_open_keys_alone_and_asks_for_an_order(spark, tmp_path):
    schema = "k bigint, t int, x string"
    frame = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), (1, 5, None), (1, 4, "d"), (1, None, "e")], schema)
    frame.coalesce(1).write.parquet(str(tmp_path / "feed"))
    stream = jobs.read_files(spark, str(tmp_path / "feed"), schema)
    with pytest.raises(ValueError):
        jobs.quarantine(stream, [Q.Unique("u", "m", ("k",))], "x", "y")
    with pytest.raises(ValueError):
        jobs.quarantine(stream, [Q.Unique("u", "m", ("k",)), Q.Unique("v", "m", ("t",))], "x", "y", order_by=["t"])
    out = str(tmp_path / "out")
    jobs.quarantine(stream, [Q.Unique("u", "m", ("k",))], out, str(tmp_path / "c"), order_by=["t", "x"]).awaitTermination()
    valid, bad = sinks.read_split(spark, out)
    assert rows(valid) == [(1, None, "e"), (None, 1, "a"), (None, 2, "b")] and rows(bad, "k", "t") == [(1, 4), (1, 5)]


def test_key_rule_keeps_one_of_equal_rows_without_python_state(spark, tmp_path):
    schema = "k bigint, t int"
    for part in ([(1, 5), (1, 5), (2, 6), (None, 1)], [(1, 5), (2, 6), (3, 7), (3, 7), (None, 1)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        stream = jobs.read_files(spark, str(tmp_path / "feed"), schema)
        rule = Q.Unique("u", "m", ("k",))
        done = jobs.quarantine(stream, [rule], str(tmp_path / "out"), str(tmp_path / "c"), order_by=["t"])
        done.awaitTermination()
        assert [s["operatorName"] for s in done.lastProgress["stateOperators"]] == ["dedupe"]
    valid, bad = sinks.read_split(spark, str(tmp_path / "out"))
    assert rows(valid) == [(1, 5), (2, 6), (3, 7), (None, 1), (None, 1)]
    assert rows(bad, "k", "t") == [(1, 5), (1, 5), (2, 6), (3, 7)]
