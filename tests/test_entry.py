"""Every registered query with a DuckDB counterpart gives its rows at the smallest scale."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value.isoformat() if isinstance(value, datetime.datetime) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(entry.oracle_sql()[name])
    theirs = [d[0] for d in found.description]
    assert columns == sorted(theirs)
    want = sorted(repr([plain(dict(zip(theirs, r, strict=True))[c]) for c in columns]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
