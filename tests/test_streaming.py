"""Counters, strategies, checkpoints and the micro-batch adapter."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexil.operators import attention as A
from vexil.operators.config import AttentionConfig, IndexConfig
from vexil.streaming import append as R

DIM, VALUE = 8, 4
INDEX = IndexConfig(num_lists=4, nprobe=2, num_subspaces=2, num_bits=3, coarse_max_iter=1, pq_max_iter=1)
ATTEND = AttentionConfig(sink=2, local=4, top_fraction=0.2, mode="hybrid", value_mode="centroid", update_interval=3)
SCHEMA = "stream_id long, pos long, key array<double>, value array<double>"


def rows(spark, first, last):
    out = []
    for p in range(first, last):
        rng = np.random.default_rng(p)
        out += [(s, p, rng.standard_normal(DIM).tolist(), rng.standard_normal(VALUE).tolist()) for s in (0, 1)]
    return spark.createDataFrame(out, SCHEMA)


def queries(spark):
    rng = np.random.default_rng(77)
    return spark.createDataFrame([(i, i, rng.standard_normal(DIM).tolist()) for i in (0, 1)], "query_id long, stream_id long, q array<double>")


def outputs(df):
    return {(r["query_id"], r["d"]): r["value"] for r in df.collect()}


def test_rows_wait_until_the_interval(spark):
    s = R.Stream.build(rows(spark, 0, 40), INDEX, ATTEND, DIM)
    assert s.index.codes.count() == 2 * 34
    for p in (40, 41):
        s.append(rows(spark, p, p + 1))
        assert (s.pending, s.index.codes.count()) == (p - 39, 68)
    s.append(rows(spark, 42, 43))
    assert (s.pending, s.index.codes.count(), s.counters.adds) == (0, 74, 1)
    full = replace(ATTEND, top_fraction=1.0, value_mode="denominator")
    s.attention = full
    assert outputs(s.forward(queries(spark), VALUE)) == pytest.approx(outputs(A.dense(queries(spark), rows(spark, 0, 43), DIM**-0.5, DIM, VALUE)))


@pytest.mark.parametrize("strategy", ["online", "rebuild", "deferred"])
def test_strategies(spark, strategy):
    s = R.Stream.build(rows(spark, 0, 30), INDEX, replace(ATTEND, strategy=strategy), DIM)
    s.append(rows(spark, 30, 33), 3)
    if strategy == "deferred":
        assert s.waiting and s.counters.deferred == 1 and s.index.codes.count() == 48
        s.append(rows(spark, 33, 36), 3)
        assert s.counters.deferred == 1 and s.apply_pending() and not s.apply_pending()
    assert s.counters.rebuilds == (strategy == "rebuild") and s.counters.online_updates == (strategy != "rebuild")
    assert s.index.codes.count() == 2 * (s.length - 6)


def test_enough_new_rows_rebuild(spark):
    s = R.Stream.build(rows(spark, 0, 30), INDEX, replace(ATTEND, codebook_refresh_interval=5), DIM)
    s.append(rows(spark, 30, 33), 3)
    assert (s.counters.adds, s.counters.rebuilds) == (1, 0)
    s.append(rows(spark, 33, 36), 3)
    assert (s.counters.adds, s.counters.rebuilds) == (1, 1)


def test_short_sequences_have_no_index(spark):
    s = R.Stream.build(rows(spark, 0, 5), INDEX, ATTEND, DIM)
    assert s.index is None
    assert outputs(s.forward(queries(spark), VALUE)) == pytest.approx(outputs(A.dense(queries(spark), rows(spark, 0, 5), DIM**-0.5, DIM, VALUE)))


def test_checkpoint_extend_and_accept(spark):
    s = R.Stream.build(rows(spark, 0, 30), INDEX, replace(ATTEND, strategy="deferred"), DIM)
    saved = s.checkpoint()
    before = outputs(s.forward(queries(spark), VALUE))
    s.append(rows(spark, 30, 34), 4)
    s.apply_pending()
    assert s.restore(saved) and s.length == 30
    assert outputs(s.forward(queries(spark), VALUE)) == pytest.approx(before)
    assert not s.restore(None) and not s.extend_prefix(saved, rows(spark, 29, 30), 30) and not s.extend_prefix(saved, rows(spark, 29, 60), 60, room=50)
    assert s.extend_prefix(saved, rows(spark, 29, 50), 50) and s.length == 50 and s.indexed_length == 50 and s.rows.count() == 100
    base = s.checkpoint()
    s.append(rows(spark, 50, 54), 4)
    assert s.accept(base, 4, 54) == "commit" and s.accept(base, 4, 52) == "rollback" and s.length == 52
    assert s.kv().agg(F.max("pos")).first()[0] == 51 and s.accept(base, 4, 80) == "rebuild"
    with pytest.raises(ValueError):
        s.append_many(rows(spark, 90, 91), 90, 1, 1)


def test_flushes_fall_between_chunks(spark):
    s = R.Stream.build(rows(spark, 0, 30), INDEX, replace(ATTEND, strategy="deferred"), DIM)
    assert s.append_many(rows(spark, 28, 40), 28, 12, 4) == 2 and s.length == 40 and s.waiting


def test_decisions():
    ids = list(range(10))
    d = R.digest(ids[:8])
    assert R.extension_reason(8, d, ids, 0.5) is None and R.extension_reason(10, d, ids, 0.5) == "not_longer"
    assert R.extension_reason(8, R.digest([1]), ids, 0.5) == "prefix_differs" and R.extension_reason(8, d, ids, 0.1) == "too_much_new"
    assert [R.next_action(*a) for a in ((None, 5, True), (5, 6, False), (5, 4, True), (5, 9, True), (5, 9, False))] == ["rebuild", "append", "restore", "extend", "rebuild"]


def test_requests(spark):
    s = R.Stream.build(rows(spark, 0, 8), INDEX, ATTEND, DIM)
    held = R.Requests({"a": s, "b": s})
    assert held.step(["a", "c"], {"a": 1, "c": 1}, 4) == "missing_id" and held.step(["a"], {"a": 2}, 4) == "not_one_row"
    assert held.step(["a"], {"a": 1}, 9) == "too_short" and set(held.streams) == {"a", "b"}
    assert held.step(["a"], {"a": 1}, 4) is None and set(held.streams) == {"a"}


def test_stream_gives_the_same_as_batch(spark, tmp_path):
    rows(spark, 30, 36).write.parquet(f"{tmp_path}/in")
    s = R.Stream.build(rows(spark, 0, 30), INDEX, ATTEND, DIM)
    table = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    R.follow(table, s, f"{tmp_path}/checkpoint").awaitTermination()
    batch = R.Stream.build(rows(spark, 0, 30), INDEX, ATTEND, DIM)
    batch.append(rows(spark, 30, 36), 6)
    assert s.length == 36 and outputs(s.forward(queries(spark), VALUE)) == pytest.approx(outputs(batch.forward(queries(spark), VALUE)))
    R.each_batch(s)(rows(spark, 30, 36), 7)
    assert s.length == 36
