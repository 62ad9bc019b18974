"""Every registered query with SQL equals DuckDB's result; the others run."""

import os

import duckdb
import pytest
from tessella.plans import queries as q


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_equals_sql(spark, sf, con, name):
    df = q.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({q.SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(cols).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_entry_has_rows():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_topk_plan_keeps_k_rows_a_task(spark, sf):
    df = q.QUERIES["topk_cosine"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_filter_reaches_the_scan(spark, sf):
    plan = q.QUERIES["topk_filtered"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "In(source" in plan
