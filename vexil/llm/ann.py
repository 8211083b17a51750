"""Approximate nearest neighbours by collision counting over single projections.

Vectors lie in hashed blocks of bounded size. In a block each projection's values are one sorted array. A query's window around its own projected value is widened
step by step (virtual rehashing: no buckets are stored for the wider radii); a vector inside the window collides on that projection, and one that collides on enough
projections is verified by its exact inner product. If windows grow over the whole block, every vector is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexil.llm.common import stash

#: Projections, and the share of them a vector must collide on; first half-width of a window (times the block's largest norm) and its growth; windows grow until this
#: share of the block, and what is asked for, is verified.
PROJECTIONS, THRESHOLD, START, GROWTH, VERIFIED = 128, 0.9, 1.0, 1.15, 0.12
#: Vectors and queries a block. A block's norms lie within a factor, up to the last of so many classes of norms.
BLOCK, QUERY_BLOCK, FACTOR, CLASSES = 8192, 2048, 0.9, 32
_AT_ONCE, _CACHED = 256, 1024


def usable(vector: Column) -> Column:
    """Not null, not all zero, every component a finite number."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok & F.exists(vector, lambda x: x != 0), F.lit(False))


class Index:
    """Sorted projections of one block. Inner products become distances by one more component, the square root of bound**2 - |x|**2."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bound: float, seed: int = 5, projections: int = PROJECTIONS) -> None:
        self.ids, self.x, self.bound = ids, vectors, bound
        extra = np.sqrt(np.maximum(bound * bound - np.einsum("ij,ij->i", vectors, vectors), 0.0))
        self.axes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, projections))
        values = np.ascontiguousarray((np.column_stack([vectors, extra]) @ self.axes).T)
        order = values.argsort(1, kind="stable")
        self.sorted = np.take_along_axis(values, order, 1)
        # of each projection the place of each vector: it lies in a window if its place does; some vectors' places together stay in the processor's cache
        place = np.empty(order.shape, np.uint16 if len(ids) <= 0xFFFF else np.uint32)
        np.put_along_axis(place, order, np.arange(len(ids), dtype=place.dtype)[None, :], 1)
        self.places = [np.ascontiguousarray(place[:, i : i + _CACHED]) for i in range(0, len(ids), _CACHED)]

    def windows(self, at: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """First place and number of places of each query's window on each projection."""
        first = np.stack([s.searchsorted(at[:, i] - width, "left") for i, s in enumerate(self.sorted)], 1)
        end = np.stack([s.searchsorted(at[:, i] + width, "right") for i, s in enumerate(self.sorted)], 1)
        kind = self.places[0].dtype
        return first.astype(kind)[:, :, None], (end - first).astype(kind)[:, :, None]

    def search(self, owns: np.ndarray, queries: np.ndarray, k: int, threshold: float = THRESHOLD, verified: float = VERIFIED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query ids and scores of the best k found, best first, ties to the smaller id; the query's own id is left out.

        Window bounds of all queries are looked up at once, a projection and a width at a time. A wider window holds all that a narrower one does, so the first width
        that suffices is looked for from the one that the query before took, up or down; it is the one that widening from the first finds.
        """
        n, p = len(self.ids), len(self.sorted)
        at = (queries * (self.bound / np.sqrt(np.einsum("ij,ij->i", queries, queries)))[:, None]) @ self.axes[:-1]
        need, want = int(np.ceil(threshold * p)), min(n, k + 1 + int(np.ceil(verified * n)))
        widths, bounds = [START * self.bound], []
        counts = np.empty(n, np.uint8 if p <= 0xFF else np.uint16)
        away = [np.empty_like(x) for x in (self.places[0], self.places[-1])]
        inside = [np.empty(x.shape, bool) for x in away]

        def often(j: int, step: int) -> np.ndarray:
            """Which vectors collide often enough with query j at that step; what lies before a window wraps round to a number beyond it."""
            while len(bounds) <= step:
                bounds.append(self.windows(at, widths[-1]))
                widths.append(widths[-1] * GROWTH)
            first, size = bounds[step]
            for i, place in enumerate(self.places):
                last = i + 1 == len(self.places)
                np.less(np.subtract(place, first[j], out=away[last]), size[j], out=inside[last])
                np.add.reduce(inside[last].view(np.uint8), axis=0, dtype=counts.dtype, out=counts[i * _CACHED : (i + 1) * _CACHED])
            return counts >= need

        step = 0
        for j, (own, q) in enumerate(zip(owns, queries, strict=True)):
            found = often(j, step)
            if np.count_nonzero(found) < want:
                while np.count_nonzero(found) < want:
                    step += 1
                    found = often(j, step)
            else:
                while step and np.count_nonzero(less := often(j, step - 1)) >= want:
                    step, found = step - 1, less
            rows = np.flatnonzero(found & (self.ids != own))
            score = self.x.take(rows, 0)
            score = np.multiply(score, q, out=score).sum(1)
            if len(rows) > 4 * k:
                some = score >= np.partition(score, len(rows) - k)[len(rows) - k]
                rows, score = rows[some], score[some]
            best = np.lexsort((self.ids[rows], -score))[:k]
            yield self.ids[rows][best], score[best]


def nearest(vectors: DataFrame, queries: Column, k: int = 20, block: int = BLOCK, query_block: int = QUERY_BLOCK, seed: int = 5) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) for vectors(vec_id, embedding): for each row that `queries` selects its k nearest by inner product, nearest first.

    Vectors are dealt into blocks by class of norm, then by hash, so that the component that makes inner products distances is small in each. Every query block meets
    every vector block; a block pair is one bounded task, and only k rows a query leave it. Vectors null, zero, with null or non-finite
    components, of another length than the longest, or without an id take no part. Rows with a query's id are its own. A vec_id that repeats is answered
    once, for its least vector. Equal scores go to the smaller vec_id. An empty table gives no rows.
    """
    rows = stash(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v")).filter("vec_id is not null").filter(usable(F.col("v"))), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    dim, bound, asked = rows.agg(F.max(F.size("v")), F.max(norm), F.sum(queries.cast("int"))).first()
    rows = rows.filter(F.size("v") == F.lit(dim or 0))
    share = F.nanvl(norm / float(bound or 1.0), F.lit(1.0))
    class_ = F.least(F.lit(CLASSES - 1), F.floor(F.log(F.greatest(share, F.lit(1e-300))) / float(np.log(FACTOR)))).cast("int")
    sizes = dict(rows.groupBy(class_.alias("c")).count().collect())
    parts = [max(1, -(-sizes.get(c, 0) // block)) for c in range(CLASSES)]
    starts = np.cumsum([0, *parts]).tolist()
    query_blocks = max(1, -(-(asked or 0) // query_block))
    at = lambda numbers: F.element_at(F.array(*map(F.lit, numbers)), class_ + 1)
    home = (at(starts[:-1]) + F.pmod(F.xxhash64("vec_id", F.lit(1)), at(parts))).cast("int")
    held_blocks = [b for c, n in sizes.items() for b in range(starts[c], starts[c] + parts[c])] or [0]
    held = rows.select(home.alias("b"), F.lit(False).alias("asks"), "vec_id", "v").select("*", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    asks = rows.filter(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    dealt = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(query_blocks)).cast("int")
    asks = asks.select(dealt.alias("qb"), F.lit(True).alias("asks"), "vec_id", "v").select("*", F.explode(F.array(*map(F.lit, sorted(held_blocks)))).alias("b"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf["asks"].to_numpy()
        out: list[tuple] = []
        if mine.any() and not mine.all():
            x = np.stack(pdf["v"][~mine].to_list())
            index = Index(pdf["vec_id"][~mine].to_numpy(), x, float(np.sqrt(np.einsum("ij,ij->i", x, x).max())), seed)
            owns, asked = pdf["vec_id"][mine].to_numpy(), np.stack(pdf["v"][mine].to_list())
            for i in range(0, len(owns), _AT_ONCE):
                for own, (ids, score) in zip(owns[i : i + _AT_ONCE], index.search(owns[i : i + _AT_ONCE], asked[i : i + _AT_ONCE], k), strict=True):
                    out += zip([own] * len(ids), ids, score, strict=True)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    parts = held.unionByName(asks).groupBy("qb", "b").applyInPandas(search, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, k: int) -> Iterator[tuple[int, list[int]]]:
    """The exact answer on the driver, for tests and for measuring recall on a small table."""
    for own in ids[asked]:
        q = x[ids == own][0]
        score = (x * q).sum(1)
        order = np.lexsort((ids, -score))
        yield int(own), [int(i) for i in ids[order] if i != own][:k]
