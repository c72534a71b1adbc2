"""All registered queries: importing the query modules fills the registry."""

from callboard.plans import (  # noqa: F401
    queries_basic,
    queries_changes,
    queries_lookups,
    queries_quality,
    queries_reports,
    queries_sets,
    queries_streams,
)
from callboard.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
