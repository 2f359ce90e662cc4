"""Registered queries against their SQL on the smallest data."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import normalise

FOLDER = "/root/testdata/sf0.001"
# Those of the text operators have their own folder and tests.
NAMES = sorted(n for n in entry.oracle_sql() if not re.match(r"op\d+_|pipeline$", n))


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, connection, name):
    df = entry.queries()[name](spark, FOLDER)
    result = connection.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert normalise(df.columns, [tuple(r) for r in df.collect()]) == normalise(columns, result.fetchall())


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert not [n for n in entry.queries() if not re.fullmatch(r"[a-z0-9_]+", n)]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
