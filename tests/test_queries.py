"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from themeloom.catalog.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages conversations".split()
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def comparable(row):
    return tuple(
        "nan" if isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x
        for x in row
    )


# the queries of the llm subpackage have their own test, over their own tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((comparable(r[c] for c in columns) for r in df.collect()), key=str)
    if name not in ORACLES:
        assert got
        return
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    expected = sorted(
        (comparable(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=str
    )
    assert got == expected


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(queries())
