"""Every registered query runs, and those with SQL agree with it."""

import duckdb
import pytest

from cohortloom.plans import catalog
from tools.oracle_check import TABLES, compare


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, con, small, name):
    ok, note = compare(catalog.QUERIES[name](spark, small), con, catalog.SQL[name])
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, small, name):
    df = catalog.QUERIES[name](spark, small)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())
