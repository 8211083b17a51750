"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from vexil.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return x


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in registry.ORACLE:
        assert got
        return
    out = duck.execute(registry.ORACLE[name])
    have = [d[0] for d in out.description]
    assert sorted(have) == cols
    want = sorted((tuple(plain(r[have.index(c)]) for c in cols) for r in out.fetchall()), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(a == b or (isinstance(a, float) and isinstance(b, (int, float)) and abs(a - b) <= 2e-6) for a, b in zip(g, w)), (g, w)
