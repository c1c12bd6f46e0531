"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

BASE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{BASE}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return repr(value) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, BASE)
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(plain(v) for v in row) for row in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(SQL) <= set(entry.queries())
