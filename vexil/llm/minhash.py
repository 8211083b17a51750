"""Near-duplicate detection by min-max hashing over word shingles.

Each permutation gives a minimum and a maximum, so 80 hash evaluations make 160 signature values: 32 bands of five. A pair at a similarity of exactly 0.8 shares
no band with a probability of (1 - 0.8**5)**32 = 3e-6; every candidate is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexil.llm.common import maybe_broadcast, mix64, shingle_sets, small_batches, stash
from vexil.llm.graph import components

PERMS, BAND_ROWS = 80, 5
BANDS = 2 * PERMS // BAND_ROWS
#: Rounds of comparing with one head a bucket; different heads a group and round.
ROUNDS, HEADS = 3, 4
#: Members of a bucket that are dealt together; a larger bucket has several parts, and its head goes to each.
PART = 1024
#: Bits that tell sets apart before their shingles are compared.
ODD = 512
_CHUNK = 1 << 15
_RNG = np.random.Generator(np.random.PCG64(7))
_XOR = _RNG.integers(0, 2**64, PERMS, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row a non-empty set: the minima, then the maxima, of its values under all permutations."""
    out = np.empty((len(sets), 2 * PERMS), np.uint64)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= _CHUNK):
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[at:end])
        first = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        for i in range(PERMS):
            h = (x ^ _XOR[i]) * _MUL[i]
            out[at:end, i] = np.minimum.reduceat(h, first)
            out[at:end, PERMS + i] = np.maximum.reduceat(h, first)
        at = end
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key a band; the same values in another band make another key."""
    parts = sig.reshape(len(sig), BANDS, BAND_ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :].repeat(len(sig), 0)
    for j in range(BAND_ROWS):
        key = mix64(key * np.uint64(0x2545F4914F6CDD1D) + parts[:, :, j])
    return key.view(np.int64)


def _sketch(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = list(shingle_sets(pdf["text"].tolist(), width))
            some = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            for i, row in zip(some, bands(signatures([sets[i] for i in some])) if some else (), strict=True):
                keys[i] = row
            one = np.array([mix64(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            two = np.array([mix64(s + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": [len(s) for s in sets], "d1": one, "d2": two, "bands": keys})

    return run


def odd_bits(mixed: np.ndarray) -> np.ndarray:
    """ODD bits of a set, as numbers of 64: a bit is set if an odd number of shingles falls on it. Two sets differ in at least as many shingles as bits."""
    return np.packbits((np.bincount((mixed % np.uint64(ODD)).astype(np.int64), minlength=ODD) & 1).astype(np.uint8)).view(np.int64)


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = list(shingle_sets(pdf["text"].tolist(), width))
            mixed = [mix64(s) for s in sets]
            one = np.array([m.sum(dtype=np.uint64) for m in mixed], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "d1": one, "odd": [odd_bits(m) for m in mixed], "shingles": [s.view(np.int64) for s in sets]})

    return run


def _sized(ids: DataFrame) -> DataFrame:
    ids = stash(ids, "ids")
    return maybe_broadcast(ids, ids.count(), 32)


def _of(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of some ids."""
    return sets.join(_sized(ids), "doc_id", "left_semi")


def _with_sets(pairs: DataFrame, sets: DataFrame, side: str, other: str) -> DataFrame:
    """pairs with the set of one side. A document in very many pairs has its set sent to as many parts as they are dealt in."""
    often = stash(pairs.groupBy(side).agg(F.count("*").alias("n")).filter(F.col("n") > PART).select(side, F.ceil(F.col("n") / PART).cast("int").alias("parts")), "often")
    hot = maybe_broadcast(often, often.count(), 32)
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(hot, side, "left").withColumn("salt", F.pmod(F.xxhash64(other), parts).cast("int")).drop("parts")
    own = sets.select(F.col("doc_id").alias(side), F.col("shingles").alias(f"s{side}")).join(hot, side, "left")
    return dealt.join(own.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts"), [side, "salt"]).drop("salt")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b) those with 100 * intersection >= percent * union of their full sets."""
    some = stash(_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), sets), "sets")
    both = _with_sets(_with_sets(pairs, some, "b", "a"), some, "a", "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct()


def _fits(x: str, y: str, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _prefix_pairs(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of left(rep, n, comp) across components that can reach the similarity: all that do are among them.

    Under one order of all shingles, rarest first, two sets that are similar enough share one of their first n - ceil(percent / 100 * n) + 1. So only those are joined,
    and documents meet at shingles that few of them have, not in their buckets. Three exact bounds are part of that join: sizes; what can still be common from the
    places of the shared shingle on (true of the first shared one); and the bits in which the sets differ.
    """
    mine = _of(left.select(F.col("rep").alias("doc_id")).distinct(), sets)
    held = stash(mine.select("doc_id", "d1", F.explode("shingles").alias("s")), "shingles")
    often = held.groupBy("s").agg(F.count("*").alias("df"))
    order = held.join(often, "s").groupBy(F.col("doc_id").alias("rep"), "d1").agg(F.sort_array(F.collect_set(F.struct("df", "s"))).alias("order"))
    n = F.size("order")
    head = F.slice("order", F.lit(1), n - F.floor((percent * n + 99) / 100).cast("int") + 1)
    first = order.select("rep", "d1", n.alias("n"), F.posexplode(head).alias("at", "e")).filter("e.df > 1").select("rep", "d1", "n", "at", "e.s")
    bits = mine.select(F.col("doc_id").alias("rep"), "d1", "odd").dropDuplicates(["rep", "d1"]).join(left.select("rep", "comp").distinct(), "rep")
    first = first.join(stash(bits, "bits"), ["rep", "d1"]).drop("d1")
    x, y = (first.select("s", *(F.col(c).alias(c + side) for c in ("rep", "n", "at", "comp", "odd"))) for side in "xy")
    ahead = F.least(F.col("nx") - F.col("atx"), F.col("ny") - F.col("aty"))
    differ = sum((F.bit_count(F.get("oddx", F.lit(i)).bitwiseXOR(F.get("oddy", F.lit(i)))) for i in range(ODD // 64)), F.lit(0))
    size = F.col("nx") + F.col("ny")
    fits = _fits("nx", "ny", percent) & ((100 + percent) * ahead >= percent * size) & ((100 + percent) * differ <= (100 - percent) * size)
    met = x.join(y, (x["s"] == y["s"]) & (F.col("repx") < F.col("repy")) & (F.col("compx") != F.col("compy")) & fits)
    return met.select(F.col("repx").alias("a"), F.col("repy").alias("b")).distinct()


def _salted(keys: DataFrame) -> DataFrame:
    """keys(key, parts, ...) as often as the key's bucket has parts."""
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for docs(doc_id, text).

    Equal sets become one representative, its least doc_id, before any pair is made, so copies cost no pairs. Then, in rounds, every representative in a band
    bucket is compared with one head of the bucket, and what the links join is one component; the heads differ by round, and buckets that hold one component
    only are done. So a large group of near copies is joined by a few comparisons a member, and a bucket's members are dealt in parts of bounded size. The
    representatives left in buckets of several components are compared across components where they share one of their rarest shingles; that bound is exact,
    so no link between components that share a band is lost. Sets of all representatives in shared buckets are made once.

    Texts that are null, empty or without words have n_shingles 0, stand alone and are kept. A null doc_id is linked with nothing: component_id null, kept true.
    Rows that share a doc_id are one document with several texts. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    made = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(_sketch(width), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")
    made = stash(made, "sketch")
    rows = made.filter("n_shingles > 0 and doc_id is not null")
    reps = stash(rows.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("r")).select("d1", "d2", "r.*"), "reps")
    banded = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key", F.ceil(F.col("size") / PART).cast("int").alias("parts"))
    # written first, so that the join has two plain sides and AQE can split a hot key
    members = banded.join(stash(shared, "shared"), "key").withColumn("salt", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    members = stash(members.select("key", "parts", "salt", "rep", "n", F.col("rep").alias("comp")), "buckets")
    # of rows that share a doc_id each is a representative of its own set; the links are the document's
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(_sized(members.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi")
    sets = stash(some.mapInPandas(_sets(width), "doc_id long, d1 long, odd array<long>, shingles array<long>"), "sets")

    def still_open(held: DataFrame) -> DataFrame:
        keys = held.groupBy("key", "parts").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key", "parts")
        return stash(held.join(_salted(stash(keys, "open")), ["key", "salt"], "left_semi").select(held.columns), "buckets")

    tried = links = None
    for k in range(rounds):
        # the first heads are the least ids, the same in all buckets of a group; later ones are drawn by a hash, a few a group
        lot = F.xxhash64("rep", F.lit(k), F.pmod("key", F.lit(HEADS))) if k else F.col("rep")
        heads = members.groupBy("key", "parts").agg(F.min(F.struct(lot.alias("lot"), "rep", "n", "comp")).alias("h"))
        met = members.join(_salted(stash(heads, "heads")), ["key", "salt"]).filter((F.col("comp") != F.col("h.comp")) & _fits("n", "h.n", percent))
        pairs = met.select(F.least("rep", "h.rep").alias("a"), F.greatest("rep", "h.rep").alias("b")).distinct()
        pairs = stash(pairs.join(tried, ["a", "b"], "left_anti") if tried else pairs, "pairs")
        found = stash(_confirm(pairs, sets, percent), "links")
        tried, links = (tried.union(pairs), links.union(found)) if tried else (pairs, found)
        joined = stash(components(links), "components")
        members = members.drop("comp").join(joined, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "rep"))
        members = still_open(members.select("key", "parts", "salt", "rep", "n", "comp"))
        if members.isEmpty():
            break
    left = stash(members.select("rep", "n", "comp").distinct(), "left")
    last = stash(_prefix_pairs(left, sets, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
    final = components(links.union(_confirm(last, sets, percent)))
    of_rep = reps.select("d1", "d2", F.col("doc_id").alias("rep")).join(final, F.col("rep") == F.col("node"), "left").select("d1", "d2", F.coalesce("component", "rep").alias("c"))
    out = made.select("doc_id", "n_shingles", "d1", "d2").join(of_rep, ["d1", "d2"], "left")
    alone_ = F.col("n_shingles") == 0
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull() | alone_, F.col("doc_id")).otherwise(F.col("c")).alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without near copies: of each component the row of its least doc_id; of rows that share that doc_id and text too, one stays.

    Rows without words or without a doc_id stay. Only rows whose doc_id repeats are shuffled to find equal ones. An empty table stays empty.
    """
    found = stash(near_duplicates(docs, width, percent), "found")
    gone = stash(found.filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    left = docs.join(maybe_broadcast(gone, gone.count(), 32), "doc_id", "left_anti").select(docs.columns)
    again = stash(found.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return left
    side = maybe_broadcast(again, again.count(), 32)
    once = left.join(side, "doc_id", "left_anti").select(docs.columns)
    return once.unionByName(left.join(side, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns))
