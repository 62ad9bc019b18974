"""Queries over files and written tables equal DuckDB's result."""

import os

import duckdb
import pytest
from tessella.plans import file_queries as f
from tessella.plans import queries as q

OWN = sorted(n for n in q.SQL if q.QUERIES[n].__module__ == f.__name__)


@pytest.mark.parametrize("name", OWN)
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for table in os.listdir(sf):
        con.execute(f"create view {table.removesuffix('.parquet')} as select * from '{sf}/{table}'")
    df = q.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({q.SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(cols).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, want)) and got
