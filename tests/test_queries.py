"""Registered queries against DuckDB on small copies of the business tables."""

import os

import pytest

import __spark_entry__
from gridloom.plans.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "" if v is None else repr(round(float(v), 9) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, FOLDER)
    found = got.collect()
    assert got.columns
    if sql := ORACLE_SQL.get(name):
        want = con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got.columns, found) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["scenario", "bin_id", "feature", "n", "rho"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
