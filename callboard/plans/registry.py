"""Registry of runnable queries and, where SQL can express them, their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callboard import session
from callboard.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Data:
    """The driver tables of one folder, scanned on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = session.tune(spark), folder
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames |= load(self.spark, self.folder, [name])
        return self._frames[name]


def query(name: str, sql: str | None = None):
    """Register ``fn(data)`` under a name, with the SQL that must give the same rows."""

    def add(fn: Callable[[Data], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Data(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add
