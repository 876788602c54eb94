"""Every query against its SQL, on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
import check
from nearfield.catalog.queries import QUERIES
from nearfield.catalog.sql import SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in check.TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees(spark, db, name):
    assert check.compare(spark, db, name, FOLDER).startswith("ok")


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "id", "score", "mmr_score"]
