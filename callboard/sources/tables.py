"""Table scans with declared schemas, bound-parameter SQL and temp views."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Schemas of the driver tables, as declared in their Parquet footers.
DRIVER_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def driver_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}.parquet"


def load(
    spark: SparkSession,
    folder: str,
    names: Iterable[str],
    schemas: Mapping[str, str | T.StructType] = DRIVER_SCHEMAS,
) -> dict[str, DataFrame]:
    """Scan the named Parquet tables with their declared schema (no inference job)."""
    return {n: spark.read.schema(schemas[n]).parquet(driver_path(folder, n)) for n in names}


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)


def sql(spark: SparkSession, text: str, tables: Mapping[str, DataFrame] | None = None, **params) -> DataFrame:
    """Run SQL text with ``:name`` markers. Values are bound, never spliced into the text.

    ``tables`` are passed as ``{name}`` placeholders, so no view is left behind.
    """
    return spark.sql(text, args=params, **(tables or {}))
