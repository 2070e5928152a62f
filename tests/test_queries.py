"""Every registered query against DuckDB on the same files."""

import os

import pytest

import __spark_entry__ as entry
from wherescore.plans import oracles, queries as registry

duckdb = pytest.importorskip("duckdb")
SF_DIR = "/root/testdata/sf0.001"
TABLES = ["customer", "supplier", "part", "orders", "lineitem", "pages"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def ordered(columns, rows):
    index = [columns.index(c) for c in sorted(columns)]
    picked = [tuple(r[i] for i in index) for r in rows]
    return sorted(picked, key=lambda r: [(v is not None, str(v)) for v in r])


def test_every_query_has_sql():
    assert set(registry.registered()) == set(oracles.sql())
    assert set(registry.registered()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.registered()))
def test_query_equals_sql(spark, database, name):
    found = entry.queries()[name](spark, SF_DIR)
    cursor = database.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    expected = ordered(columns, cursor.fetchall())
    assert expected and ordered(found.columns, found.collect()) == expected


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["model", "linguistic", "environmental", "infrastructure", "overall"]
    assert found.count() == 6
