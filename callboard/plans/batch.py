"""Several reports over one catalogue: what they share is worked out once.

A report is a function of tables that builds a plan and runs nothing, so calling it with a
mapping that takes notes tells which tables it reads. Tables that two or more reports read and
that are more than a scan (a join or an aggregate stands in their plan) are written to a
working table, clustered by their key, and all reports are built on that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame

from callboard.sources import working
from callboard.sources.model import TABLES

Report = Callable[[Mapping[str, DataFrame]], DataFrame]


class _Noted(Mapping):
    def __init__(self, tables: Mapping[str, DataFrame]):
        self.tables, self.read = tables, set()

    def __getitem__(self, name: str) -> DataFrame:
        self.read.add(name)
        return self.tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.tables)

    def __len__(self) -> int:
        return len(self.tables)


def readers(tables: Mapping[str, DataFrame], reports: Mapping[str, Report]) -> dict[str, list[str]]:
    """Tables and the reports that read them."""
    found: dict[str, list[str]] = {}
    for name, report in reports.items():
        noted = _Noted(tables)
        report(noted)
        for table in noted.read:
            found.setdefault(table, []).append(name)
    return found


def is_derived(df: DataFrame) -> bool:
    """Whether more than scans, filters and projections makes the table."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return any(node in plan for node in ("Join ", "Aggregate ", "Window ", "Generate ", "Union"))


def run(tables: Mapping[str, DataFrame], reports: Mapping[str, Report]) -> dict[str, DataFrame]:
    """The reports by name, over tables of which the shared derived ones are written once.

    The written tables last until ``working.release`` or the end of a ``working.dropped_after`` block.
    """
    shared = dict(tables)
    for name, by in readers(tables, reports).items():
        if len(by) > 1 and is_derived(tables[name]):
            key = [k for k in TABLES[name].key if k in tables[name].columns] if name in TABLES else []
            frame = tables[name].repartitionByRange(*key).sortWithinPartitions(*key) if key else tables[name]
            shared[name] = working.table(frame, f"shared-{name}")
    return {name: report(shared) for name, report in reports.items()}
