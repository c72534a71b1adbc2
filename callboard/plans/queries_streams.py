"""The streaming jobs run over the driver's event files until they are used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from callboard.operators.joins import lookup
from callboard.operators.quality import Unique
from callboard.plans import bindings as B
from callboard.plans import reports as R
from callboard.plans.queries_quality import EVENT_VIOLATIONS, event_rules
from callboard.plans import queries_changes, queries_reports  # noqa: F401
from callboard.plans.registry import ORACLE, Data, query
from callboard.sources import sinks, working
from callboard.sources.tables import DRIVER_SCHEMAS, driver_path
from callboard.streaming import jobs


def _events(d: Data):
    # A glob, because the table may be one file or a folder of files.
    path = driver_path(d.folder, "event[s]")
    return jobs.read_files(d.spark, path, DRIVER_SCHEMAS["events"])


def _folders(d: Data) -> tuple[str, str]:
    """A fresh result folder and a fresh progress folder, shared by all executors."""
    root = working.folder(d.spark, "stream")
    return f"{root}/result", f"{root}/progress"


@query("stream_quarantine", EVENT_VIOLATIONS)
def _(d):
    path, progress = _folders(d)
    jobs.quarantine(_events(d), event_rules(), path, progress).awaitTermination()
    _, bad = sinks.read_split(d.spark, path)
    return bad.select("event_id", F.explode("violations").alias("v")).select("event_id", "v.rule_id", "v.message")


@query(
    "stream_unique",
    """SELECT event_id, user_id, event_type, 'event_once' AS rule_id, 'Event of this kind already recorded' AS message
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(value AS INTEGER) ORDER BY ts, event_id) AS n FROM events)
WHERE n > 1 AND user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL""",
)
def _(d):
    """Key rule on arrival: of equal keys the first in time stays, later ones are quarantined."""
    path, progress = _folders(d)
    rule = Unique("event_once", "Event of this kind already recorded", ("user_id", "event_type", "amount"))
    rows = _events(d).withColumn("amount", F.bround("value").cast("int"))
    jobs.quarantine(rows, [rule], path, progress, order_by=["ts", "event_id"]).awaitTermination()
    _, bad = sinks.read_split(d.spark, path)
    return bad.select("event_id", "user_id", "event_type", F.explode("violations").alias("v")).select(
        "event_id", "user_id", "event_type", "v.rule_id", "v.message"
    )


@query("stream_activity_summary")
def _(d):
    path, progress = _folders(d)
    log = B.activity({"events": _events(d)})
    jobs.running_summary(log, "username", R.activity_measures(), path, progress).awaitTermination()
    users = B.account(d).select("username", "full_name", "role")
    latest = jobs.latest_summary(d.spark, path, "username")
    return lookup(users, latest, {"username": "username"}, list(R.activity_measures()), R.activity_defaults())


ORACLE["stream_activity_summary"] = ORACLE["user_activity_summary"]


@query("stream_change_audit")
def _(d):
    path, progress = _folders(d)
    jobs.change_audit(_events(d), "user_id", ["ts", "event_id"], "event_type", path, progress).awaitTermination()
    return jobs.read_changes(d.spark, path)


ORACLE["stream_change_audit"] = ORACLE["audit_from_log"]
