"""Scorers, generators, logs and statistics."""

from __future__ import annotations

import difflib
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexil.functions import textscore as E
from vexil.functions import vectors as V
from vexil.operators import selectors as B
from vexil.plans import evalstats as M
from vexil.plans import taskgen as G
from vexil.sources import logs


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_scorers(spark):
    lit = F.lit
    got = one(
        spark,
        E.normalize(lit("The  Cat, sat on AN apple!")).alias("n"),
        E.f1(lit("the cat sat"), lit("a cat ran")).alias("f"),
        E.f1(lit(""), lit("x")).alias("f0"),
        E.classification(lit("it is a dog house"), lit("dog"), F.array(lit("dog"), lit("house"), lit("do"))).alias("c"),
        E.count_score(lit("5 then 7 then 5"), lit("5")).alias("k"),
        E.retrieval_score(lit("Paragraph 12"), lit("see Paragraph 12")).alias("r"),
        E.match_all(lit("Alpha beta"), F.array(lit("ALPHA"), lit("gamma"))).alias("m"),
        E.match_part(lit("Alpha beta"), F.array(lit("gamma"), lit("beta"))).alias("p"),
        E.first_int(lit("the 42 of 43"), lit("42")).alias("i"),
        E.kv_score(lit('{"k": "v1"}'), lit("v1")).alias("kv"),
        E.math_score(lit("about 3.50 or so"), lit("3.5")).alias("m1"),
        E.math_score(lit("about 3.5"), lit("3")).alias("m2"),
        E.math_score(lit("none"), lit("3")).alias("m3"),
        E.choice_score(lit("B, surely"), lit("B")).alias("c1"),
        E.choice_score(lit("the answer is C"), lit("C")).alias("c2"),
        E.choice_score(lit("answer: none. D"), lit("D")).alias("c5"),
        E.choice_score(lit("answer:"), lit("D")).alias("c6"),
        E.choice_score(lit("so\tAB it is"), lit("AB")).alias("c7"),
        E.kv_score(lit("a\tv1"), lit("v1")).alias("kv2"),
        E.without_thought(lit("<think>a</think> b</think>  c")).alias("t"),
    )
    assert (got["c5"], got["c6"], got["c7"], got["kv2"]) == (0, 0, 1, 1)
    assert got["n"] == "cat sat on apple" and got["f"] == pytest.approx(0.5) and got["f0"] == 0 and got["c"] == 0.5 and got["k"] == pytest.approx(2 / 3) and got["r"] == 1
    assert (got["m"], got["p"], got["i"], got["kv"], got["m1"], got["m2"], got["m3"], got["c1"], got["c2"], got["t"]) == (0.5, 1, 1, 1, 1, 0, 0, 1, 1, "c")


def test_udf_scorers(spark):
    df = spark.createDataFrame([("a b c d", "a x c d"), ("", "x"), (None, None), ("qabxcd", "abycdf")], "a string, b string")
    got = df.select(E.rouge_l("a", "b").alias("r"), E.fuzzy_ratio("a", "b").alias("f")).collect()
    assert [r["r"] for r in got] == [0.75, 0.0, 0.0, 0.0]
    assert got[3]["f"] == pytest.approx(round(100 * difflib.SequenceMatcher(None, "qabxcd", "abycdf").ratio()) / 100) and got[1]["f"] == 0
    code = df.select(E.code_similarity(F.lit("# c\n`x`\nreturn a"), F.lit("return a")).alias("s")).first()
    assert code["s"] == 1.0


def test_array_helpers(spark):
    a = F.array(*map(F.lit, (5, 3, 5, 1, 3, 9)))
    got = one(spark, F.array_distinct(a).alias("u"), V.difference(a, F.array(F.lit(3), F.lit(8))).alias("d"), V.positions(F.array(*map(F.lit, (10, 4, 7, 2))), F.array(*map(F.lit, (7, 10, 2)))).alias("p"), V.unpack4(V.pack4(F.array(*map(F.lit, (1, 15, 7))), 3), 3).alias("k"))
    assert (got["u"], got["d"], got["p"], got["k"]) == ([5, 3, 1, 9], [5, 5, 1, 9], [2, 0, 3], [1, 15, 7])
    with pytest.raises(Exception, match="codes must be"):
        one(spark, V.pack4(F.array(F.lit(16), F.lit(0)), 2))
    r = V.rotation(6, 3)
    v = np.arange(6.0)
    there = one(spark, V.rotate(F.array(*(F.lit(float(x)) for x in v)), r).alias("v"))["v"]
    assert there == pytest.approx(v @ r) and np.allclose(r @ r.T, np.eye(6))


def test_budget_and_quantizer():
    assert B.budget(131072, 0.01, 4, 128) == 1456 and B.budget(131072, 0.005, 4, 128) == 800
    level, edge = B.lloyd_max(16)
    assert len(level) == 8 and len(edge) == 7 and (np.diff(level) > 0).all() and level[0] > 0 and np.allclose(edge, (level[1:] + level[:-1]) / 2)


def test_collisions_find_near_keys(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 32))
    kv = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "stream_id long, pos long, key array<double>")
    qs = spark.createDataFrame([(i, 0, (x[i] + 0.2 * rng.standard_normal(32)).tolist()) for i in range(8)], "query_id long, stream_id long, q array<double>")
    regions = kv.withColumn("region", F.lit("retrieval"))
    got = B.collided(qs, regions, 5, 32, 8).collect()
    assert {(r["query_id"], r["pos"]) for r in got if r["rank"] == 1} == {(i, i) for i in range(8)}
    few = B.collided(qs, regions.filter("pos < 4"), 5, 32, 8)
    assert few.count() == 8 * 4
    own = B.selector_stats(qs, regions, B.collided(qs, regions, 5, 32, 8), 8, 5).first()
    assert own["n_records"] == 8 and own["mean_budget"] == 5 and 0.1 < own["mean_collision_share"] <= 6 / 21


def test_page_background_modes_close_the_gap(spark):
    from vexil.operators import attention as A

    rng = np.random.default_rng(6)
    kv = spark.createDataFrame([(0, i, rng.standard_normal(8).tolist(), [1.0, float(i // 16)]) for i in range(160)], "stream_id long, pos long, key array<double>, value array<double>")
    qs = spark.createDataFrame([(0, 0, rng.standard_normal(8).tolist())], "query_id long, stream_id long, q array<double>")
    pages = B.best_pages(B.page_scores(qs, kv, 8), 64)
    value = lambda df: [r["value"] for r in df.orderBy("d").collect()]
    dense = value(A.dense(qs, kv, 0.35, 8, 2))
    for mode in ("page_mean_key", "upper_bound", "ub_margin", "ub_calibrated", "alpha_true", "trunc_true"):
        got = value(B.page_background(qs, kv, pages, 0.35, 8, 2, mode))
        assert (got[0] == pytest.approx(1)) == (mode != "trunc_true")
        if mode == "alpha_true":
            assert got == pytest.approx(dense)


def test_generators(spark):
    ids = spark.range(6).select("id")
    for kind in G.KINDS:
        rows = G.samples(ids, kind, 240).collect()
        assert rows == G.samples(ids.repartition(3), kind, 240).orderBy("_id").collect() or {r["_id"] for r in rows} == {f"{kind}-{i}" for i in range(6)}
        for r in rows:
            assert r["answers"] and all(a in r["prompt"] for a in r["answers"])
    words = G.passkey(200, 0.5, "12345").split()
    assert len(words) == 200 and words.index("12345.") > 50 and words[words.index("pass") - 2].endswith(".")
    assert G.largest_that_fits(lambda n: n * n, 50) == 7
    assert [r["name"] for r in G.grid({"a": [1, 2], "b": ["x"]})] == ["a1-bx", "a2-bx"] and G.grid('[{"a": 1}]')[0]["name"] == "a1"
    got = one(spark, G.filled(F.array(F.lit("a"), F.lit("b")), 5).alias("f"), G.letter(F.array(F.lit("x"), F.lit("y")), F.lit("y")).alias("l"), G.prompt("qa", context=F.lit("C"), input=F.lit("Q")).alias("p"))
    assert got["f"] == ["a", "b", "a", "b", "a"] and got["l"] == "B" and "Question: Q" in got["p"]
    df = spark.createDataFrame([(list("abcdef"),)], "w array<string>")
    assert [r["window"] for r in G.windows(df, "w", [0, 2], 3).collect()] == [list("abc"), list("cde")]
    with pytest.raises(Exception, match="reaches beyond"):
        G.windows(df, "w", [4], 3).collect()


def test_logs(spark, tmp_path):
    lines = [{"suite": "s", "task": "t", "_id": "1", "score": 0.1}, {"suite": "s", "task": "t", "_id": "2", "score": 0.2}, {"suite": "s", "task": "t", "_id": "1", "score": 0.9}]
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(map(json.dumps, lines)) + '\n\n{"suite": "s", "task": "t", "_id": "3", "sco')
    got = {r["_id"]: (r["score"], r["repeats"]) for r in logs.scores(spark, str(path), "s").collect()}
    assert got == {"1": (0.9, 1), "2": (0.2, 0)}
    schema = "_id string, score double"
    assert [r["_id"] for r in logs.first_rows(spark, str(path), spark.createDataFrame([], schema).schema, 2).collect()] == ["1", "2"]
    samples = spark.createDataFrame([("s", "t", i) for i in "1245"], "suite string, task string, _id string")
    logs.append_log(spark.createDataFrame([("s", "t", "1"), ("s", "t", "4")], "suite string, task string, _id string"), str(tmp_path / "done"))
    assert sorted(r["_id"] for r in logs.remaining(samples, spark.read.json(str(tmp_path / "done"))).collect()) == ["2", "5"]


def test_bootstrap_replays_the_recipe(spark):
    rng = np.random.default_rng(0)
    rows = [("a-b", t, f"{i:03d}", float(rng.random()), float(rng.random())) for t in ("x", "y") for i in range(30)]
    got = {r["task"]: r for r in M.bootstrap(spark.createDataFrame(rows, "label string, task string, _id string, a double, b double"), replicates=2000).collect()}
    draw = np.random.default_rng([M.SEED, zlib.crc32(b"a-b")])
    reps = []
    for t in ("x", "y"):
        d = np.array([r[3] - r[4] for r in rows if r[1] == t])
        reps.append(np.concatenate([d[draw.integers(0, 30, (500, 30))].mean(1) for _ in range(4)]))
    macro = np.mean(reps, 0)
    assert got["macro"]["low"] == pytest.approx(np.percentile(macro, 2.5)) and got["macro"]["se"] == pytest.approx(macro.std(ddof=1))
    assert got["x"]["high"] == pytest.approx(np.percentile(reps[0], 97.5)) and got["x"]["n"] == 30
