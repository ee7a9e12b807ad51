"""Registered queries against their SQL twins at the smallest scale."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry
from tools.check_oracle import TABLES, table

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    return con


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_result(spark, sf, connection, name):
    df = entry.queries()[name](spark, sf)
    cursor = connection.execute(SQL[name])
    assert table(df.columns, df.collect()) == table(
        [c[0] for c in cursor.description], cursor.fetchall()
    )


def test_entry(spark):
    assert entry.entry(spark).count() == 2
