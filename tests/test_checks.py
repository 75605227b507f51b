"""Every registered query agrees with its SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__
from checks import ALL_QUERIES, ALL_SQL
from checks.compare import compare
from checks.fixtures import TABLE_NAMES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLE_NAMES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(ALL_QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, SF_DIR, name, con)
    assert ok, note


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(ALL_SQL) > 100
