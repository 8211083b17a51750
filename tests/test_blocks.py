import numpy as np
import pytest
from pyspark.sql import functions as F

from vexil.operators import attention as A
from vexil.operators import blocks
from vexil.operators import search as S
from vexil.operators import selectors as B

DIM, VALUE = 6, 2
KV = "stream_id long, pos long, key array<double>, value array<double>"


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 2, i, rng.normal(size=DIM).tolist(), rng.normal(size=VALUE).tolist()) for i in range(90)]
    rows += [(s, 90 + i, list(rows[s + 2][2]), [float(i), 1.0]) for i in range(6) for s in (0, 1)]
    rows += [(0, 200, None, [1.0, 1.0]), (1, 201, [None] * DIM, [1.0, 1.0])]
    asked = [(s, 10 * s + i, rng.normal(size=DIM).tolist()) for s in (0, 1) for i in range(5)] + [(0, 99, rows[2][2]), (1, 98, None)]
    return spark.createDataFrame(asked, "stream_id long, query_id long, q array<double>"), spark.createDataFrame(rows, KV)


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 16)
    monkeypatch.setattr(blocks, "ASKED", 2)


def values(df):
    return {(r.query_id, r.d): r.value for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys() and got
    assert all((got[k] is None) == (w is None) and (w is None or got[k] == pytest.approx(w)) for k, w in want.items())


def test_dense_by_blocks_is_plain_attention(tables):
    plain = A.combine(A.softmax(A.exact(*tables, 0.4, DIM)), VALUE)
    out = A.dense(*tables, 0.4, DIM, VALUE)
    assert "FlatMapCoGroupsInArrow" in A.blocks.partial(*tables, 0.4, DIM, VALUE)._jdf.queryExecution().toString()
    same(values(out), values(plain))
    parts = blocks.partial(*tables, 0.4, DIM, VALUE, F.col("pos") % 3 == 0)
    assert {r.part for r in parts.collect()} == {"true", "false"}
    same(values(A.merge_partial(parts, VALUE)), values(plain))


def test_nearest_by_blocks_keeps_ties_and_rows_without_vectors(tables):
    plain = S.top(A.exact(*tables, 0.4, DIM), 50, "logit")
    got = S.top(blocks.nearest(*tables, 50, 0.4, DIM), 50, "logit")
    pick = lambda df: sorted((r.query_id, r["rank"], r.pos, r.logit or 0.0) for r in df.collect())
    assert pick(got) == pick(plain)


def test_pages_by_blocks_give_the_mass_of_plain_logits(tables):
    """With alpha_true each page has its true mass, so the softmax's denominator is that of dense attention."""
    queries, kv = tables
    page = F.floor(F.col("pos") / 4).cast("long")
    pages = queries.select("query_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("page"))
    total = lambda df: {r.query_id: r.t for r in df.filter("m is not null").groupBy("query_id").agg(F.sum(F.exp("m") * F.col("s")).alias("t")).collect()}
    kv = kv.filter("key[0] is not null")
    got = total(blocks.page_partial(queries, kv, pages, page, 0.4, DIM, VALUE, "alpha_true"))
    want = total(blocks.partial(queries, kv, 0.4, DIM, VALUE))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(w) for k, w in want.items())


def test_collisions_by_counts_of_codes_are_those_of_sorted_products(tables):
    queries, kv = (t.withColumn(c, F.coalesce(c, F.array_repeat(F.lit(0.5), DIM))) for t, c in zip(tables, ("q", "key")))
    queries, kv = queries.filter("stream_id = 0"), kv.filter("stream_id = 0").withColumn("region", F.lit("retrieval"))
    turn = np.eye(DIM)
    plain = B.reranked(queries, kv, B.collisions(queries, kv, DIM, 3, turn), 4, DIM, 3, turn, *B.lloyd_max(2))
    got = B.collided(queries, kv, 4, DIM, 3, turn)
    pick = lambda df: sorted((r.query_id, r["rank"], r.pos, r.score) for r in df.collect())
    assert pick(got) == pick(plain)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().toString()
