"""Plan shapes that must hold at any scale, checked without running the joins."""

import re

import pytest
from conftest import SMALL

from callboard.plans.catalog import QUERIES

# Numbering joins the offsets of partitions, one row each.
NUMBERED = {n for n in QUERIES if "ids" in n or "ingest" in n} | {"status_flow_audit", "equipment_status_update", "recent_role_audit"}
EAGER = {n for n in QUERIES if n.startswith("stream_")}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are for tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_product_no_python_rows_no_forced_broadcast(spark, no_broadcast, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert not re.search(r"CartesianProduct|NestedLoop|BatchEvalPython|ArrowEvalPython", plan)
    if name not in NUMBERED:
        assert "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER - {"audit_from_log"}))
def test_no_window_over_input_rows(spark, no_broadcast, name):
    windows = re.findall(r"Window \[.*", plan_of(QUERIES[name](spark, SMALL)))
    # Only the offsets of new ids are windowed: one row per partition.
    assert all("_part" in w for w in windows)


def test_scans_read_only_needed_columns(spark):
    plan = QUERIES["status_distribution"](spark, SMALL)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<o_orderstatus:string>" in plan
    plan = QUERIES["param_sql"](spark, SMALL)._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,P)" in plan


def test_top_n_does_not_sort_the_whole_table(spark):
    for name in ("top_grossing", "recent_activity", "film_basic_preview", "recent_audit"):
        plan = plan_of(QUERIES[name](spark, SMALL))
        assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_unused_revenue_is_not_computed(spark):
    assert "lineitem" not in plan_of(QUERIES["film_basic"](spark, SMALL))
    assert "l_extendedprice" not in plan_of(QUERIES["production_summary"](spark, SMALL))


def test_preview_keeps_its_order_without_broadcasting(spark, no_broadcast):
    ids = [r["film_id"] for r in QUERIES["film_basic_preview"](spark, SMALL).collect()]
    assert len(ids) == 10 and ids == sorted(ids)


@pytest.mark.parametrize(
    "name, column", [("film_profitability", "profit"), ("top_grossing", "boxoffice_collection"), ("producer_investment", "total_investment"),
                     ("distributor_performance", "total_fees"), ("recent_audit", "timestamp"), ("recent_activity", "timestamp")],
)
def test_sorted_reports_are_sorted_over_several_partitions(spark, no_broadcast, name, column):
    values = [r[column] for r in QUERIES[name](spark, SMALL).collect()]
    known = [v for v in values if v is not None]
    assert len(known) > 3 and known == sorted(known, reverse=True) and values[: len(known)] == known
