"""Registered queries against their SQL on the smallest tables, types included."""

import math

import duckdb
import pytest

from themeloom.llm.catalog import LLM_QUERIES, LLM_SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def same(x):
    return round(x, 6) if isinstance(x, float) and not math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(LLM_QUERIES))
def test_query(spark, duck, name):
    df = LLM_QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(same(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got
    if name not in LLM_SQL:
        return
    relation = duck.sql(LLM_SQL[name])
    assert sorted(relation.columns) == columns
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    at = [relation.columns.index(c) for c in columns]
    assert got == sorted((tuple(same(r[i]) for i in at) for r in relation.fetchall()), key=str)
