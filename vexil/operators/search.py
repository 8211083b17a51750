"""Scoring coded rows, probing lists, and choosing the best: for one query or many, by one plan keyed by query_id."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexil.functions import vectors as V
from vexil.operators.ivf import Index
from vexil.sources.shared import meet, small, stash


def top(scores: DataFrame, k: int | Column, score: str = "score", by: str = "query_id") -> DataFrame:
    """scores(query_id, pos, score, ...) with rank from 1, the best k of each query, ties to the smaller pos. Each task drops what can't be among them."""
    w = Window.partitionBy(by).orderBy(F.desc(score), "pos")
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def turned(queries: DataFrame, index: Index) -> DataFrame:
    """queries(query_id, stream_id, q) with v, the query as the index projects it, and q_norm (1 without direction_normalize)."""
    v = V.doubles(F.col("q"))
    out = queries.withColumn("v", V.rotate(v, index.rotation) if index.rotation is not None else v)
    if not index.config.direction_normalize:
        return out.withColumn("q_norm", F.lit(1.0))
    return out.withColumn("q_norm", V.norm(F.col("v"), index.dim, index.config.eps)).withColumn("v", F.transform("v", lambda x: x / F.col("q_norm")))


def lookup(queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, m, code, x): a query's piece times each word."""
    asked = turned(queries, index)
    words = index.codebook.select("stream_id", "m", F.col("list_id").alias("code"), F.col("centroid").alias("w"))
    joined = asked.join(small(words, 1024), "stream_id")
    return joined.select("query_id", "stream_id", "m", "code", V.dot(V.piece(F.col("v"), F.col("m"), index.sub), F.col("w"), index.sub).alias("x"))


def bias(queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, list_id, bias): a query times each centroid; once a list, not once a row."""
    held = small(index.coarse.select("stream_id", "list_id", F.col("centroid").alias("c")), 1024)
    return turned(queries, index).join(held, "stream_id").select("query_id", "stream_id", "list_id", V.dot(F.col("v"), F.col("c"), index.dim).alias("bias"))


def tables(queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, stream_id, q_norm, lut, biases): what a row needs to be scored, as two flat arrays; a row a query, written once, so that whatever
    scores again looks up the same numbers."""
    lut = lookup(queries, index).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("m", "code", "x"))), lambda e: e["x"]).alias("lut"))
    biases = bias(queries, index).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("list_id", "bias"))), lambda e: e["bias"]).alias("biases"))
    return stash(turned(queries, index).select("query_id", "stream_id", "q_norm").join(lut, "query_id").join(biases, "query_id"), "tables")


def _score(index: Index) -> Column:
    cfg = index.config
    terms = [F.get("lut", F.lit(m * cfg.words) + F.get("codes", F.lit(m))) for m in range(cfg.num_subspaces)]
    total = reduce(add, terms)
    total = total + F.get("biases", F.col("list_id")) if cfg.residual else total
    return total * F.col("q_norm") * F.col("key_norm") if cfg.direction_normalize else total


def approximate(queries: DataFrame, index: Index, codes: DataFrame | None = None) -> DataFrame:
    """(query_id, stream_id, pos, list_id, score) of every coded row of a query's stream. The queries' tables go to the codes; codes aren't shuffled while they are small."""
    width = 8 * (index.config.num_subspaces * index.config.words + index.config.num_lists)
    met = meet(index.codes if codes is None else codes, tables(queries, index), width)
    return met.select("query_id", "stream_id", "pos", "list_id", _score(index).alias("score"))


def packed_score(config_words: int, pieces: int, pairs: bool = False) -> Column:
    """The sum of a query's looked-up terms for a row's `packed` codes, two a byte; with pairs, one look-up a byte in the tables that pair_tables() makes."""
    byte = lambda i: F.get("packed", F.lit(i)).cast("int")
    if pairs:
        return reduce(add, (F.get("pair_lut", F.lit(256 * i) + byte(i)) for i in range(-(-pieces // 2))))
    low = lambda m: byte(m // 2).bitwiseAND(F.lit(15)) if m % 2 == 0 else F.shiftright(byte(m // 2), 4)
    return reduce(add, (F.get("lut", F.lit(m * config_words) + low(m)) for m in range(pieces)))


def pair_tables(asked: DataFrame, pieces: int) -> DataFrame:
    """tables() with pair_lut: for each byte of packed codes the 256 sums of its two terms; a last odd piece stands alone."""
    term = lambda m, code: F.get("lut", F.lit(16 * m) + code) if m < pieces else F.lit(0.0)
    every = F.sequence(F.lit(0), F.lit(255))
    one = lambda i: F.transform(every, lambda b: term(2 * i, b.bitwiseAND(F.lit(15))) + term(2 * i + 1, F.shiftright(b, 4)))
    return asked.withColumn("pair_lut", F.concat(*(one(i) for i in range(-(-pieces // 2)))))


def packed_scan(queries: DataFrame, index: Index, packed: DataFrame, pairs: bool = False) -> DataFrame:
    """(query_id, stream_id, pos, list_id, score) from stored packed(stream_id, pos, list_id, packed, key_norm): nothing is unpacked into an array. 4-bit codes only."""
    if index.config.num_bits != 4:
        raise ValueError("packed codes have 4 bits")
    pieces = index.config.num_subspaces
    asked = tables(queries, index)
    asked = pair_tables(asked, pieces) if pairs else asked
    met = meet(packed, asked, 8 * (256 * pieces + index.config.num_lists))
    score = packed_score(index.config.words, pieces, pairs)
    score = score + F.get("biases", F.col("list_id")) if index.config.residual else score
    score = score * F.col("q_norm") * F.col("key_norm") if index.config.direction_normalize else score
    return met.select("query_id", "stream_id", "pos", "list_id", score.alias("score"))


def probed_top(scores: DataFrame, probed: DataFrame, k: int) -> DataFrame:
    """Top k of scores that are there already, among the rows of each query's probed lists."""
    return top(scores.join(small(probed.select("query_id", "list_id"), 32), ["query_id", "list_id"], "left_semi"), k)


def block_top(scores: DataFrame, k: int, block: int) -> DataFrame:
    """Top k by blocks of positions: the best k of each block, then the best k of those. The same rows as top(), and no task sorts a query's whole sequence."""
    w = Window.partitionBy("query_id", "_b").orderBy(F.desc("score"), "pos")
    held = scores.withColumn("_b", F.floor(F.col("pos") / block)).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_b", "_r")
    return top(held, k)


def histogram_top(scores: DataFrame, k: int, bins: int = 256) -> DataFrame:
    """Top k after a histogram: scores are counted in equal bins between a query's ends, and rows below the bin that the k-th falls in don't meet the sort.

    Exact: the bin's rows all stay. Counts are summed in each task first; a row a query and bin is shuffled.
    """
    ends = stash(scores.groupBy("query_id").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi")), "ends")
    held = scores.join(small(ends, 32), "query_id")
    width = (F.col("_hi") - F.col("_lo")) / bins
    held = held.withColumn("_b", F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("score") - F.col("_lo")) / width))).otherwise(0))
    w = Window.partitionBy("query_id").orderBy(F.desc("_b"))
    counts = held.groupBy("query_id", "_b").agg(F.count("*").alias("_n")).withColumn("_ahead", F.sum("_n").over(w) - F.col("_n"))
    least = stash(counts.filter(F.col("_ahead") < k).groupBy("query_id").agg(F.min("_b").alias("_least")), "bins")
    return top(held.join(small(least, 32), "query_id").filter(F.col("_b") >= F.col("_least")).select(*scores.columns), k)


def probes(queries: DataFrame, index: Index, nprobe: int) -> DataFrame:
    """(query_id, stream_id, list_id, rank): the nprobe lists of largest query times centroid (at least one), ties to the smaller list."""
    w = Window.partitionBy("query_id").orderBy(F.desc("bias"), "list_id")
    return bias(queries, index).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= max(1, nprobe)).drop("bias")


def candidates(probed: DataFrame, index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, stream_id, pos, list_id, codes, key_norm): rows of the probed lists; a query whose lists are all empty gets all rows of its stream."""
    found = index.codes.join(small(probed.select("query_id", "stream_id", "list_id"), 32), ["stream_id", "list_id"])
    without = queries.select("query_id", "stream_id").join(found.select("query_id").distinct(), "query_id", "left_anti")
    rest = index.codes.join(small(without, 32), "stream_id")
    cols = ["query_id", "stream_id", "pos", "list_id", "codes", "key_norm"]
    return found.select(cols).union(rest.select(cols))


def score_candidates(chosen: DataFrame, queries: DataFrame, index: Index) -> DataFrame:
    width = 8 * (index.config.num_subspaces * index.config.words + index.config.num_lists)
    return chosen.join(small(tables(queries, index).drop("stream_id"), width), "query_id").select("query_id", "stream_id", "pos", "list_id", _score(index).alias("score"))


def search(queries: DataFrame, index: Index, topk: int, nprobe: int, budget: int | None = None) -> dict[str, DataFrame]:
    """Tables probes, candidates (the best max(budget, topk) of the probed rows) and topk (the best topk), all with ranks."""
    if topk <= 0:
        raise ValueError("topk must be positive")
    probed = probes(queries, index, nprobe)
    scored = score_candidates(candidates(probed, index, queries), queries, index)
    held = top(scored, max(budget, topk)) if budget is not None else scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")).cast("long"))
    return {"probes": probed, "candidates": held, "topk": held.filter(F.col("rank") <= topk)}


def listmax(scores: DataFrame, nprobe: int, k: int) -> DataFrame:
    """Top k among the rows of the nprobe lists that hold the largest scores."""
    best = scores.groupBy("query_id", "list_id").agg(F.max("score").alias("best"))
    w = Window.partitionBy("query_id").orderBy(F.desc("best"), "list_id")
    lists = best.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= nprobe).select("query_id", "list_id")
    return top(scores.join(small(lists, 32), ["query_id", "list_id"], "left_semi"), k)


def slotted(probed: DataFrame, index: Index, per_list: int) -> DataFrame:
    """(query_id, stream_id, list_id, pos, ...): of each probed list the first per_list rows."""
    w = Window.partitionBy("stream_id", "list_id").orderBy("pos")
    first = index.codes.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_list).drop("_r")
    return first.join(small(probed.select("query_id", "stream_id", "list_id"), 32), ["stream_id", "list_id"])


def group_mean(queries: DataFrame, group: int, dim: int) -> DataFrame:
    """(query_id, stream_id, q): one query a group of `group` heads, their mean; its id is the group's number."""
    kv_head = F.floor(F.col("query_id") / group).cast("long")
    return queries.groupBy(kv_head.alias("query_id"), "stream_id").agg(V.mean_by_dim(V.doubles(F.col("q")), dim).alias("q"))


def shared_topk(queries: DataFrame, index: Index, group: int, k: int) -> DataFrame:
    """(query_id, pos, rank): top k of a group's mean query, for each head of the group."""
    best = top(approximate(group_mean(queries, group, index.dim), index), k).select(F.col("query_id").alias("g"), "pos", "rank")
    return queries.select("query_id", F.floor(F.col("query_id") / group).cast("long").alias("g")).join(best, "g").select("query_id", "pos", "rank")


def reuse_steps(steps: DataFrame, dim: int, least: float, most_age: int, how: str = "min") -> DataFrame:
    """(stream_id, step, reused): whether a step keeps the top-k of an earlier one, for steps(stream_id, step, head, q).

    A step is alike the one before if the cosines of its heads (their min, mean or median) reach `least`; after most_age reused steps in a row it is scored again.
    """
    w = Window.partitionBy("stream_id", "head").orderBy("step")
    q = V.doubles(F.col("q"))
    cos = V.dot(F.col("_q"), F.col("_p"), dim) / (V.norm(F.col("_q"), dim) * V.norm(F.col("_p"), dim))
    agg = {"min": F.min, "mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5))}[how]
    pairs = steps.withColumn("_q", q).withColumn("_p", F.lag(q).over(w))
    alike = pairs.groupBy("stream_id", "step").agg((agg(cos) >= least).alias("alike")).withColumn("alike", F.coalesce("alike", F.lit(False)))
    own = Window.partitionBy("stream_id").orderBy("step")
    run = alike.withColumn("_g", F.sum(F.when(F.col("alike"), 0).otherwise(1)).over(own))
    age = F.row_number().over(Window.partitionBy("stream_id", "_g").orderBy("step")) - 1
    return run.withColumn("_age", age).select("stream_id", "step", (F.pmod("_age", F.lit(most_age + 1)) > 0).alias("reused"))


# how many


def fraction_k(n: Column, fraction: float) -> Column:
    """ceil(n * fraction), from 0 to n."""
    return F.greatest(F.lit(0), F.least(n, F.ceil(n.cast("double") * F.lit(float(fraction))))).cast("long")


def nucleus(logits: DataFrame, p: float, prefix: Column | None = None) -> DataFrame:
    """(query_id, k): how many rows, best first, hold a softmax mass of p: those before which less than p has gathered, so at least one.

    prefix: a column with the mass that is there before any row (of rows that are always kept, in the same softmax); with it, 0 if that is p already.
    logits(query_id, pos, logit, and mass if a prefix is given).
    """
    every, order = Window.partitionBy("query_id"), Window.partitionBy("query_id").orderBy(F.desc("logit"), "pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    if prefix is None:
        e = F.exp(F.col("logit") - F.max("logit").over(every))
        rows = logits.withColumn("mass", e / F.sum(e).over(every))
    else:
        rows = logits
    gathered = F.coalesce(F.sum("mass").over(before), F.lit(0.0)) + (prefix if prefix is not None else F.lit(0.0))
    return rows.withColumn("_in", gathered < p).groupBy("query_id").agg(F.count_if("_in").alias("k"))
