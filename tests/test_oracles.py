"""Every query of the catalogue with its statement, on the smallest tables."""

import collections
import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from flowspark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, database, name):
    df = QUERIES[name](spark, SF)
    answer = database.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(answer.columns)
    order = sorted(df.columns)
    places = [answer.columns.index(c) for c in order]
    got = collections.Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert got == collections.Counter(tuple(plain(r[p]) for p in places) for r in answer.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1000
    assert set(entry.oracle_sql()) <= set(entry.queries())
