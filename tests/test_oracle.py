"""Every query that SQL can express gives the rows of its SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else int(x) if x == int(x) else round(x, 6)
    if hasattr(x, "as_tuple"):
        return plain(float(x))
    return x


def rows(columns, got):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in got), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(name, spark, duck):
    df = entry.queries()[name](spark, FOLDER)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(k for k in set(entry.queries()) - set(entry.oracle_sql()) if not k.startswith(("op", "pipeline"))))
def test_query_without_sql(name, spark):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    got = df.collect()
    assert 0 < len(got) <= 20 and [r["rank"] for r in got] == sorted(r["rank"] for r in got)
    assert got[0].distance == 0.0
