"""Every registered engine query against its SQL, over the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from sievework.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    shown = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(v)
    got = sorted(tuple(map(shown, r)) for r in df.select(*cols).collect())
    cur = duck.execute(ORACLE_SQL[name])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(at) == cols
    assert got == sorted(tuple(shown(r[at[c]]) for c in cols) for r in cur.fetchall())
