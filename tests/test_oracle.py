"""Every registered query against its SQL on DuckDB, over the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry
from relweave import suite
from tools.check_queries import TABLES, compare

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert compare(got, duck.execute(SQL[name]).df()) == "ok"


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_every_query_of_the_library_has_sql():
    assert set(suite.QUERIES) == set(suite.SQL)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r["passed"] for r in rows)


def test_c2st_bounds(spark):
    found = {r["table"]: r["accuracy"] for r in QUERIES["det_c2st"](spark, DATA).collect()}
    assert abs(found["same"] - 0.5) < 0.15
    assert found["shifted"] > 0.6
