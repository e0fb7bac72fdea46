"""Every query with SQL gives the same rows in DuckDB."""

import duckdb
import pytest

from strandlog.plans import catalog, catalog_io, catalog_state, catalog_views

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE_SQL = catalog.QUERIES | catalog_views.QUERIES | catalog_state.QUERIES | catalog_io.QUERIES, catalog.ORACLE_SQL | catalog_views.ORACLE_SQL | catalog_state.ORACLE_SQL | catalog_io.ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "conversations"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(columns, found):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([r[i] for i in at]) for r in found)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_as_in_duckdb(spark, duck, name):
    own, other = QUERIES[name](spark, DATA), duck.sql(ORACLE_SQL[name])
    assert sorted(own.columns) == sorted(other.columns)
    assert rows(own.columns, map(tuple, own.collect())) == rows(other.columns, other.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
