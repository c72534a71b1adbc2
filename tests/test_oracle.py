"""Every registered query against its reference SQL in DuckDB, over whole tables."""

import compare
import pytest
from conftest import ORACLE_FOLDER, SMALL

import __spark_entry__ as contract
from callboard.plans import catalog

QUERIES, ORACLE = catalog.QUERIES, catalog.ORACLE


@pytest.fixture(scope="module")
def db():
    return compare.connect(ORACLE_FOLDER)


def test_every_query_has_reference_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_reference_sql(spark, db, name):
    assert compare.difference(QUERIES[name](spark, ORACLE_FOLDER), db, ORACLE[name]) is None


def test_entry_runs_the_flagship_query(spark):
    df = contract.entry(spark)
    assert df.columns[:3] == ["film_id", "title", "budget"] and df.count() > 0
    assert compare.difference(df, compare.connect(SMALL), ORACLE["film_profitability"]) is None
