import time

import numpy as np
from pyspark.sql import functions as F

from vexil.llm import ann


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def recall(spark, x, **kw):
    x = np.asarray(x, np.float32).astype(float)
    got = ann.nearest(table(spark, x), F.col("vec_id") % 20 == 0, **kw).collect()
    ids = np.arange(len(x))
    by = {}
    for r in got:
        by.setdefault(r["query_id"], {})[r["rank"]] = r
    hit = total = 0
    for own, want in ann.brute_force(ids, x, ids % 20 == 0, 20):
        ranks = by[own]
        assert sorted(ranks) == list(range(1, len(want) + 1))
        order = [(-ranks[k]["score"], ranks[k]["vec_id"]) for k in sorted(ranks)]
        assert order == sorted(order)
        assert all(abs(r["score"] - x[r["vec_id"]] @ x[own]) < 1e-9 for r in ranks.values())
        hit += len({r["vec_id"] for r in ranks.values()} & set(want))
        total += len(want)
    return hit / total


def test_recall_on_hard_and_on_unequal_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 32))
    assert recall(spark, x / np.linalg.norm(x, axis=1, keepdims=True), block=1000) >= 0.9
    assert recall(spark, x[:1500] * rng.uniform(0.2, 3, (1500, 1)), block=800, query_block=20) >= 0.9


def test_ties_copies_and_few_rows(spark):
    assert recall(spark, np.tile([[1.0, 0.0], [0.6, 0.8]], (40, 1))) == 1.0
    assert recall(spark, np.eye(3)) == 1.0


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (7, [0.5, 0.5]), (None, [1.0, 1.0]), (8, [-1.0, 0.0]), (8, [-1.0, 0.0]), (20, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 7, 0.5), (0, 8, -1.0), (0, 8, -1.0)]


def test_empty(spark):
    assert ann.nearest(table(spark, np.zeros((0, 2))), F.lit(True)).count() == 0


def widened(index, asked, k, spent):
    """The index's search written plainly: places counted one by one, windows widened from the first on. spent: gets the seconds of counting alone."""
    n = len(index.ids)
    order = [np.argsort(values, kind="stable") for values in (np.column_stack([index.x, np.sqrt(np.maximum(index.bound**2 - (index.x**2).sum(1), 0))]) @ index.axes).T]
    need, want = int(np.ceil(ann.THRESHOLD * len(order))), min(n, k + 1 + int(np.ceil(ann.VERIFIED * n)))
    for q in asked:
        at = (q * (index.bound / np.linalg.norm(q))) @ index.axes[:-1]
        width, counts, lo, hi = ann.START * index.bound, np.zeros(n, int), None, None
        while True:
            a = [s.searchsorted(v - width, "left") for s, v in zip(index.sorted, at, strict=True)]
            b = [s.searchsorted(v + width, "right") for s, v in zip(index.sorted, at, strict=True)]
            parts = [o[x:y] for o, *ends in zip(order, a, lo or a, hi or a, b, strict=True) for x, y in ((ends[0], ends[1]), (ends[2], ends[3]))]
            begin = time.process_time()
            counts += np.bincount(np.concatenate(parts), minlength=n)
            spent.append(time.process_time() - begin)
            if np.count_nonzero(counts >= need) >= want:
                break
            lo, hi, width = a, b, width * ann.GROWTH
        yield np.flatnonzero(counts >= need)


def best(index, own, q, rows, k):
    rows = rows[index.ids[rows] != own]
    score = (index.x[rows] * q).sum(1)
    return index.ids[rows][np.lexsort((index.ids[rows], -score))[:k]].tolist()


def test_windows_find_what_widening_finds_in_less_time():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6000, 48))
    index, asked = ann.Index(np.arange(6000), x, float(np.linalg.norm(x, axis=1).max())), x[:60]
    counting, searching = [], []
    for _ in range(3):
        counting.append([])
        want = [best(index, i, q, rows, 20) for i, (q, rows) in enumerate(zip(asked, widened(index, asked, 20, counting[-1]), strict=True))]
        begin = time.process_time()
        got = [ids.tolist() for ids, _ in index.search(np.arange(60), asked, 20)]
        searching.append(time.process_time() - begin)
    assert got == want
    assert min(searching) < 0.9 * min(map(sum, counting))


def test_a_block_of_more_places_than_16_bits():
    x = np.random.default_rng(4).standard_normal((66000, 3))
    index = ann.Index(np.arange(66000), x, float(np.linalg.norm(x, axis=1).max()), projections=20)
    want = [best(index, i, q, rows, 5) for i, (q, rows) in enumerate(zip(x[:4], widened(index, x[:4], 5, []), strict=True))]
    assert [ids.tolist() for ids, _ in index.search(np.arange(4), x[:4], 5)] == want
