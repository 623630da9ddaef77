"""Every query with SQL against DuckDB on the smallest tables."""

import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float | decimal.Decimal):
        return f"{float(x):.9g}"
    if isinstance(x, list | tuple):
        return str([value(y) for y in x])
    return str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    places = [want.columns.index(c) for c in order]
    assert sorted(tuple(map(value, r)) for r in got.select(*order).collect()) == sorted(tuple(value(r[i]) for i in places) for r in want.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
