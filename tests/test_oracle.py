"""Every registered query against its DuckDB twin on the smallest tables."""

import pytest

from tests.conftest import SMALL
from tests.oracle_harness import compare, duck

import __spark_entry__ as E
from fleetscope.plans import catalog

QUERIES = catalog.queries()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], SQL[name], SMALL)
    assert r["status"] == "MATCH", r


def test_every_query_runs(spark):
    for name, fn in QUERIES.items():
        if name in SQL:
            continue
        df = fn(spark, SMALL)
        assert df.count() >= 0, name


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "state" in df.columns and "headline" in df.columns
