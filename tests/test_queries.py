"""Every query with SQL against that SQL, over whole small tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, Decimal):
        return int(v)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    found = entry.queries()[name](spark, DATA)
    names = sorted(found.columns)
    res = duck.execute(SQL[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == names
    want = sorted((tuple(plain(r[cols.index(c)]) for c in names) for r in res.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in names) for r in found.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if k not in entry.oracle_sql() and not k.startswith("op") and k != "pipeline"))
def test_without_sql(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "doc_id", "score", "rank"]
