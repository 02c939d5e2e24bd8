"""Registered queries against their SQL, and the shape of the plans."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as contract
from check_queries import TABLES, table_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, oracle, name):
    df = QUERIES[name](spark, FOLDER)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = oracle.execute(SQL[name])
    assert got == table_of([d[0] for d in cursor.description], cursor.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_give_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_runs(spark):
    assert contract.entry(spark).count() == 3


@pytest.mark.parametrize("name", ["keep_one_last", "lookup_join", "row_list_sorted", "scan_samples"])
def test_one_per_key_is_cut_before_the_shuffle(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["row_list_plain"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice)" in plan or "o_totalprice,100000.0" in plan
    scan = QUERIES["histogram"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_totalprice:double>" in scan
