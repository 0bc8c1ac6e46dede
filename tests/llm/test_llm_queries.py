"""The operators' queries with SQL against DuckDB."""

import glob
import os

import duckdb
import pytest

from tracelume.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df, want = queries.queries()[name](spark, SF), c.sql(queries.oracle_sql()[name])
    place = [want.columns.index(k) for k in df.columns]
    assert sorted(str(list(r)) for r in df.collect()) == sorted(str([r[i] for i in place]) for r in want.fetchall())
