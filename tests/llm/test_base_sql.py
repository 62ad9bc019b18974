"""The parts that SQL can express equal DuckDB's result."""

import os

import duckdb
import pytest

from tessella.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for table in os.listdir(sf):
        con.execute(f"create view {table.removesuffix('.parquet')} as select * from '{sf}/{table}'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({queries.SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(cols).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, want)) and got
