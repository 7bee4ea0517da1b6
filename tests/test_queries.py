"""Every registered query runs, and equals its check SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from loomlog.plans.check_sql import CHECKS
from loomlog.plans.queries import QUERIES

SF_DIR = entry.SMOKE_DIR
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(CHECKS)


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["actor", "action_name", "action_type"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = entry.queries()[name](spark, SF_DIR)
    columns = sorted(found.columns)
    mine = [tuple(plain(r[c]) for c in columns) for r in found.collect()]
    assert mine
    checked = duck.sql(entry.oracle_sql()[name])
    assert sorted(checked.columns) == columns
    places = [checked.columns.index(c) for c in columns]
    theirs = [tuple(plain(r[p]) for p in places) for r in checked.fetchall()]
    key = lambda row: [(v is None, str(v)) for v in row]
    assert sorted(mine, key=key) == sorted(theirs, key=key)
