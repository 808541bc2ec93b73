"""Every query with SQL gives what DuckDB gives, at the smallest size."""

import os

import duckdb
import pytest

from kiln.plans.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        path = f"{FOLDER}/{name}"
        con.sql(f"create view {name[:-8]} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sql, name):
    got = QUERIES[name](spark, FOLDER)
    cols = sorted(got.columns)
    want = sql.sql(ORACLES[name])
    assert cols == sorted(want.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in (x.asDict() for x in got.collect())]
    at = [want.columns.index(c) for c in cols]
    assert sorted(map(str, rows)) == sorted(str(tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at)) for r in want.fetchall())
    spark.catalog.clearCache()


def test_queries_without_sql_run(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, FOLDER).count() >= 0
