"""Every plan that SQL can express, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, int) or type(value).__name__ in ("float", "Decimal"):
        return round(float(value), 5) + 0.0
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in data), key=str)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_plan_gives_the_rows_of_its_sql(spark, duck, name):
    wanted = duck.execute(registry.ORACLE_SQL[name])
    columns, data = [c[0] for c in wanted.description], wanted.fetchall()
    got = registry.QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, data)


def test_entry_knows_every_plan():
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLE_SQL) <= set(entry.oracle_sql())
