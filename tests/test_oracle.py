"""Every query with an SQL oracle, compared with DuckDB over the whole tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def ordered(rows, names):
    by_name = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in by_name) for row in rows), key=repr)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_matches_sql(spark, duck, name):
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    expected = ordered(result.fetchall(), names)
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    assert ordered([tuple(r) for r in df.collect()], df.columns) == expected


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
