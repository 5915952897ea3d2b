"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from loomgraph.plans.catalogue import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


def plain(value):
    if value is None or value != value:
        return "null"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = oracle.execute(SQL[name])
    assert sorted(d[0] for d in want.description) == columns
    place = [[d[0] for d in want.description].index(c) for c in columns]
    expected = sorted(tuple(plain(row[i]) for i in place) for row in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == expected


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)
