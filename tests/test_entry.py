from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TESSELLA_TEST_DATA", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
NAMES = [n for n in entry.oracle_sql()]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sql, name):
    df = entry.queries()[name](spark, DATA)
    found = sql.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in found.description)
    assert sorted(df.columns) == columns
    at = [next(k for k, d in enumerate(found.description) if d[0] == c) for c in columns]
    want = sorted((tuple(r[k] for k in at) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


def test_upsert_meets_the_whole_table(spark, sql):
    got = entry.queries()["upsert_dense"](spark, DATA)
    n, new, replaced = sql.execute("SELECT count(DISTINCT id), count(DISTINCT id) FILTER (attributes.active), count(DISTINCT id) FILTER (attributes.active AND content IS NOT NULL) FROM dense").fetchone()
    assert got.count() == n + new and got.filter("content LIKE '% (new)'").count() == replaced > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
