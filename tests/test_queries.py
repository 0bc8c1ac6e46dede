"""Every query with SQL against DuckDB, and the entry."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from tracelume.plans import oracle, queries

SF = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", [q for q in queries.queries() if "bucket" not in q or "60" in q])
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert table(df.columns, rows) == table(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
