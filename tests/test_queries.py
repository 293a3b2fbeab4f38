"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view \"{f[:-8]}\" as select * from '{DIR}/{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", [k for k in SQL if k in entry.queries()])
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    r = duck.sql(SQL[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert sorted(tuple(plain(x[c]) for c in cols) for x in df.collect()) == sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
