"""Identities of the index: scores by table equal products with decoded keys, batches equal single queries, maintenance and round trips."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexil.operators import attention as A
from vexil.operators import ivf
from vexil.operators import kmeans as K
from vexil.operators import search as S
from vexil.operators.config import AttentionConfig, IndexConfig
from vexil.sources import paged, snapshot
from vexil.sources.shared import stash

DIM, VALUE = 16, 6
BASE = IndexConfig(num_lists=5, nprobe=2, num_subspaces=4, num_bits=3, coarse_max_iter=3, pq_max_iter=2)


def keys(n, seed=0, streams=2):
    rng = np.random.default_rng(seed)
    return [(s, i, rng.standard_normal(DIM).tolist(), rng.standard_normal(VALUE).tolist()) for s in range(streams) for i in range(n)]


@pytest.fixture(scope="module")
def kv(spark):
    return stash(spark.createDataFrame(keys(90), "stream_id long, pos long, key array<double>, value array<double>"), "kv")


@pytest.fixture(scope="module")
def queries(spark):
    rng = np.random.default_rng(9)
    return spark.createDataFrame([(i, i % 2, rng.standard_normal(DIM).tolist()) for i in range(4)], "query_id long, stream_id long, q array<double>")


def table(df, *names):
    return {tuple(r[n] for n in names[:-1]): r[names[-1]] for r in df.collect()}


@pytest.mark.parametrize("change", [{}, {"residual": False}, {"rotation": "random_orthogonal"}, {"direction_normalize": True}, {"rotation": "random_orthogonal", "direction_normalize": True, "num_bits": 4}])
def test_score_is_the_product_with_the_reconstruction(kv, queries, change):
    index = ivf.build(kv, replace(BASE, **change), DIM)
    got = table(S.approximate(queries, index), "query_id", "pos", "score")
    made = {(r["stream_id"], r["pos"]): np.array(r["key"]) for r in ivf.reconstruct(index).collect()}
    assert len(made) == 180 and len(got) == 360
    for r in queries.collect():
        for pos in range(90):
            assert got[r["query_id"], pos] == pytest.approx(np.array(r["q"]) @ made[r["stream_id"], pos], abs=1e-9)


def test_many_queries_equal_each_alone(kv, queries):
    index = ivf.build(kv, BASE, DIM)
    every = S.search(queries, index, 7, 2, 20)
    for i in range(4):
        alone = S.search(queries.filter(F.col("query_id") == i), index, 7, 2, 20)
        for name in ("probes", "candidates", "topk"):
            cols = [c for c in every[name].columns]
            assert sorted(map(tuple, every[name].filter(F.col("query_id") == i).select(cols).collect())) == sorted(map(tuple, alone[name].select(cols).collect()))
    with pytest.raises(ValueError):
        S.search(queries, index, 0, 2)


def test_empty_lists_fall_back_to_all_rows(kv, queries):
    index = ivf.build(kv, BASE, DIM)
    probed = S.probes(queries, index, 2)
    none = probed.withColumn("list_id", F.lit(99))
    assert S.candidates(none, index, queries).count() == 360
    assert S.candidates(probed, index, queries).count() < 360


def test_lists_partition_the_rows(kv):
    _, assigned = K.kmeans(ivf.projected(kv, BASE, DIM, None), ["stream_id"], 5, DIM, 3)
    lists = K.inverted(assigned, 5).collect()
    for s in (0, 1):
        mine = sorted((r for r in lists if r["stream_id"] == s), key=lambda r: r["list_id"])
        assert sorted(p for r in mine for p in r["members"]) == list(range(90))
        assert [r["first"] for r in mine] == np.cumsum([0, *(r["n"] for r in mine[:-1])]).tolist()


def test_one_centroid_is_never_updated(kv):
    points = ivf.projected(kv, BASE, DIM, None)
    centroids, _ = K.kmeans(points, ["stream_id"], 1, DIM, 5)
    rows = {tuple(r["key"]) for r in kv.collect()}
    assert all(tuple(r["centroid"]) in rows for r in centroids.collect())


def test_an_empty_list_is_filled_anew(spark):
    df = spark.createDataFrame([(0, i, [float(i), 0.0], [0.0]) for i in range(6)], "stream_id long, pos long, v array<double>, value array<double>")
    init = spark.createDataFrame([(0, 0, [900.0, 900.0]), (0, 1, [0.0, 0.0])], "stream_id long, list_id int, centroid array<double>")
    kept, _ = K.kmeans(df, ["stream_id"], 2, 2, 2, init, refill=False)
    assert [900.0, 900.0] in [r["centroid"] for r in kept.collect()]
    filled, _ = K.kmeans(df, ["stream_id"], 2, 2, 2, init)
    assert [900.0, 900.0] not in [r["centroid"] for r in filled.collect()]


def test_add_keeps_old_codes_and_refresh_moves_centroids(kv, spark):
    old = kv.filter("pos < 70")
    index = ivf.build(old, BASE, DIM)
    more = ivf.add(index, kv.filter("pos >= 70"))
    fixed = ivf.build_with_codebooks(kv, BASE, DIM, index.coarse, index.codebook)
    assert table(more.codes, "stream_id", "pos", "codes") == table(fixed.codes, "stream_id", "pos", "codes")
    online = ivf.online_refresh(index, kv, kv.filter("pos >= 70"), 0.5)
    delta = ivf.delta_flush(index, kv.filter("pos >= 70"), 0.5)
    assert table(online.coarse, "stream_id", "list_id", "centroid") == table(delta.coarse, "stream_id", "list_id", "centroid") != table(index.coarse, "stream_id", "list_id", "centroid")
    before = table(index.codes, "stream_id", "pos", "codes")
    after = table(delta.codes, "stream_id", "pos", "codes")
    assert all(after[k] == v for k, v in before.items()) and len(after) == 180
    with pytest.raises(ValueError):
        ivf.online_refresh(index, kv, kv, 0.0)
    assert ivf.rebuild(index, kv).codes.count() == 180


def test_shared_codebook(kv):
    index = ivf.shared_layer(kv, BASE, DIM)
    by = {}
    for r in index.codebook.collect():
        by.setdefault(r["stream_id"], {})[r["m"], r["list_id"]] = tuple(r["centroid"])
    assert by[0] == by[1] and index.codes.count() == 180


def test_snapshot(kv, queries, tmp_path, spark):
    index = ivf.build(kv, replace(BASE, rotation="random_orthogonal"), DIM)
    snapshot.save(index, str(tmp_path / "index"))
    again = snapshot.load(spark, str(tmp_path / "index"), index.config)
    assert table(S.approximate(queries, index), "query_id", "pos", "score") == table(S.approximate(queries, again), "query_id", "pos", "score")
    with pytest.raises(ValueError):
        snapshot.load(spark, str(tmp_path / "index"), BASE)


def test_settings_are_checked():
    for bad in ({"num_bits": 9}, {"rotation": "x"}, {"online_codebook_lr": 0.0}, {"num_lists": 0}):
        with pytest.raises(ValueError):
            IndexConfig(**bad)
    for bad in ({"top_fraction": 0.0}, {"top_p": 1.5}, {"top_p": 0.5, "top_fraction": 0.5}, {"denominator_source": "ivf_candidates"}, {"top_p_scope": "denominator"}, {"sink": -1}, {"update_interval": 0}):
        with pytest.raises(ValueError):
            AttentionConfig(**bad)
    with pytest.raises(ValueError):
        BASE.check(10, 5)


def test_paged(spark):
    rows = [(p, s, [float(b * 4 + s)], [0.0]) for b, p in enumerate((7, 3, 9)) for s in range(4)]
    blocks = spark.createDataFrame(rows, "physical_block long, slot long, key array<double>, value array<double>")
    tab = spark.createDataFrame([(0, b, p) for b, p in enumerate((7, 3, 9))], "seq_id long, logical_block long, physical_block long")
    assert {r["pos"]: r["key"][0] for r in paged.gather(tab, blocks, 4).collect()} == {i: float(i) for i in range(12)}
    assert sorted(r["pos"] for r in paged.gather(tab, blocks, 4, 3, 9).collect()) == list(range(3, 9))
    wanted = spark.createDataFrame([(0, 10), (0, 1)], "seq_id long, pos long")
    assert {r["pos"]: r["key"][0] for r in paged.gather_at(tab, blocks, 4, wanted).collect()} == {10: 10.0, 1: 1.0}


def outputs(df):
    return {(r["query_id"], r["d"]): r["value"] for r in df.collect()}


@pytest.fixture(scope="module")
def setting(kv):
    regions = A.regions(kv, 3, 8)
    return regions, ivf.build(regions.filter("region = 'retrieval'"), BASE, DIM)


def test_everything_chosen_equals_dense(kv, queries, setting):
    regions, index = setting
    dense = outputs(A.dense(queries, kv, DIM**-0.5, DIM, VALUE))
    for mode in ("sparse", "hybrid"):
        cfg = AttentionConfig(sink=3, local=8, top_fraction=1.0, mode=mode)
        got = outputs(A.attend(A.hybrid_logits(queries, regions, index, cfg, DIM), cfg, VALUE))
        assert got == pytest.approx(dense, abs=1e-9)


def test_hybrid_by_hand(queries, setting):
    regions, index = setting
    cfg = AttentionConfig(sink=3, local=8, top_fraction=0.1, mode="hybrid", value_mode="centroid")
    rows = A.hybrid_logits(queries, regions, index, cfg, DIM).collect()
    approx = table(S.approximate(queries, index), "query_id", "pos", "score")
    lists = table(index.codes, "stream_id", "pos", "list_id")
    means = {}
    values = {(r["stream_id"], r["pos"]): np.array(r["value"]) for r in regions.collect()}
    for (s, p), li in lists.items():
        means.setdefault((s, li), []).append(values[s, p])
    data = {(r["stream_id"], r["pos"]): np.array(r["key"]) for r in regions.collect()}
    want = {}
    for r in queries.collect():
        q, s = np.array(r["q"]), r["stream_id"]
        best = sorted(range(3, 82), key=lambda p: (-approx[r["query_id"], p], p))[:8]
        logit = {p: q @ data[s, p] / 4 if p < 3 or p >= 82 or p in best else approx[r["query_id"], p] / 4 for p in range(90)}
        z = sum(np.exp(x) for x in logit.values())
        out = sum(np.exp(logit[p]) / z * (values[s, p] if p < 3 or p >= 82 or p in best else np.mean(means[s, lists[s, p]], 0)) for p in range(90))
        want |= {(r["query_id"], d): out[d] for d in range(VALUE)}
        assert sum(1 for x in rows if x["query_id"] == r["query_id"] and x["chosen"]) == 3 + 8 + 8
    logits = A.hybrid_logits(queries, regions, index, cfg, DIM)
    held = K.value_means(index.codes.join(regions.select("stream_id", "pos", "value"), ["stream_id", "pos"]), VALUE)
    assert outputs(A.attend(logits, cfg, VALUE, held)) == pytest.approx(want, abs=1e-9)
    weights = A.softmax(logits)
    total = {r["query_id"]: r["w"] for r in weights.groupBy("query_id").agg(F.sum("w").alias("w")).collect()}
    assert total == pytest.approx({i: 1.0 for i in range(4)})


def test_nothing_to_retrieve(kv, queries):
    few = kv.filter("pos < 9")
    regions = A.regions(few, 3, 8)
    assert regions.filter("region = 'retrieval'").count() == 0
    want = outputs(A.dense(queries, few, DIM**-0.5, DIM, VALUE))
    parts = A.partial(A.exact(queries, regions, DIM**-0.5, DIM), "region", VALUE)
    assert outputs(A.merge_partial(parts, VALUE)) == pytest.approx(want)


def test_nucleus_with_prefix_can_choose_nothing(spark):
    logits = spark.createDataFrame([(0, i, 0.0, 0.02) for i in range(10)], "query_id long, pos long, logit double, mass double")
    assert S.nucleus(logits, 0.5, F.lit(0.8)).first()["k"] == 0
    assert S.nucleus(logits, 0.55).first()["k"] == 6
    assert S.nucleus(logits, 0.01).first()["k"] == 1
