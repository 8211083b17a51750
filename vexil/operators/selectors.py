"""Other rules to choose rows: pages by bound, pages by their best token, votes of late queries, anchors, collisions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexil.functions import vectors as V
from vexil.operators import attention as A
from vexil.operators import blocks
from vexil.sources.shared import meet, small, stash

PAGE = 16


def budget(length: int, fraction: float, sink: int, local: int) -> int:
    """Tokens for a fraction of what lies between sink and local, with both, rounded up to whole pages."""
    return PAGE * math.ceil((sink + local + math.ceil(fraction * max(0, length - sink - local))) / PAGE)


def budget_of(length: Column, fraction: float, sink: int, local: int) -> Column:
    """budget() of a column of lengths."""
    inner = F.lit(sink + local) + F.ceil(F.lit(fraction) * F.greatest(F.lit(0), length - (sink + local)))
    return (PAGE * F.ceil(inner / PAGE)).cast("long")


def page(pos: str = "pos", size: int = PAGE) -> Column:
    return F.floor(F.col(pos) / size).cast("long")


def page_bounds(kv: DataFrame, dim: int) -> DataFrame:
    """(stream_id, page, lo, hi, n): least and largest key component of each page."""
    k = V.doubles(F.col("key"))
    ends = lambda f: F.array(*(f(F.get(k, F.lit(i))) for i in range(dim)))
    return kv.groupBy("stream_id", page().alias("page")).agg(ends(F.min).alias("lo"), ends(F.max).alias("hi"), F.count("*").alias("n"))


def page_scores(queries: DataFrame, kv: DataFrame, dim: int) -> DataFrame:
    """(query_id, stream_id, page, score): an upper bound of every product with a key of the page: sum over components of the larger of q*lo and q*hi."""
    return blocks.bounds(queries, page_bounds(kv, dim), dim)


def best_pages(scores: DataFrame, tokens: int) -> DataFrame:
    """(query_id, page): the max(3, tokens // 16) pages of largest score, at most all, ties to the smaller page."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "page")
    return scores.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max(3, tokens // PAGE)).select("query_id", "stream_id", "page")


def _of_pages(queries: DataFrame, kv: DataFrame, pages: DataFrame, scale: float, dim: int) -> DataFrame:
    """(query_id, page, pos, logit, value): exact logits of the tokens of a query's pages; no other key is multiplied."""
    rows = kv.withColumn("page", page()).join(small(pages.select("query_id", "stream_id", "page"), 32), ["stream_id", "page"])
    held = small(queries.select("query_id", V.doubles(F.col("q")).alias("_q")), 8 * dim + 32)
    return rows.join(held, "query_id").select("query_id", "page", "pos", (V.dot(F.col("_q"), V.doubles(F.col("key")), dim) * F.lit(scale)).alias("logit"), "value")


def page_attention(queries: DataFrame, kv: DataFrame, pages: DataFrame, scale: float, dim: int, dim_value: int) -> DataFrame:
    """Attention over the tokens of a query's pages only."""
    return A.combine(A.softmax(_of_pages(queries, kv, pages, scale, dim)), dim_value)


PAGE_MODES = ("page_mean_key", "upper_bound", "ub_margin", "ub_calibrated", "alpha_true", "trunc_true")


def page_background(queries: DataFrame, kv: DataFrame, pages: DataFrame, scale: float, dim: int, dim_value: int, mode: str = "page_mean_key") -> DataFrame:
    """(query_id, d, value): tokens of chosen pages exactly, every other page as one row of its logit times its number of tokens, with its mean value.

    Logit of a page, by mode: page_mean_key, product with the mean key; upper_bound, the bound; ub_margin, the bound less half of the bound's distance to the mean;
    ub_calibrated, the bound shifted so that bounds and true means of chosen pages agree on average; alpha_true, the logarithm of the mean of exp of its tokens'
    logits, so that the page has its true mass; trunc_true, as alpha_true in the denominator but without a value. Only what the mode looks at is computed, and
    block by block of whole pages: a row a query and block is merged.
    """
    if mode not in PAGE_MODES:
        raise ValueError(f"mode must be one of {', '.join(PAGE_MODES)}")
    pages = stash(pages.select("query_id", "page"), "pages")
    shift = stash(blocks.page_shift(queries, kv, pages, page(), scale, dim), "shift") if mode == "ub_calibrated" else None
    return A.merge_partial(blocks.page_partial(queries, kv, pages, page(), scale, dim, dim_value, mode, shift), dim_value)


def page_best_token(queries: DataFrame, kv: DataFrame, pages: DataFrame, scale: float, dim: int, dim_value: int) -> DataFrame:
    """The same with each other page standing as its best token: that token's logit and value, once."""
    pages = stash(pages.select("query_id", "page"), "pages")
    return A.merge_partial(blocks.page_partial(queries, kv, pages, page(), scale, dim, dim_value, "best_token"), dim_value)


def votes(kv: DataFrame, late: DataFrame, scale: float, dim: int) -> DataFrame:
    """(stream_id, pos, vote): causal softmax mass that the late queries (stream_id, q_pos, q) of all heads of a stream give to each key, summed."""
    asked = late.select("stream_id", F.col("q_pos"), F.xxhash64("stream_id", "q_pos", "q_head").alias("query_id"), "q")
    held = asked.select("query_id", "stream_id", "q_pos", V.doubles(F.col("q")).alias("_q"))
    logits = meet(kv, held, 8 * dim + 32).filter("pos <= q_pos")
    logits = logits.select("query_id", "stream_id", "pos", (V.dot(F.col("_q"), V.doubles(F.col("key")), dim) * F.lit(scale)).alias("logit"))
    return A.softmax(logits).groupBy("stream_id", "pos").agg(F.sum("w").alias("vote"))


def voted(kv: DataFrame, late: DataFrame, scale: float, dim: int, sink: int, tail: int, tokens: int, pool: int = 7) -> DataFrame:
    """(stream_id, pos): sink and tail rows, and of the others those of largest pooled vote, up to `tokens` in all; ties to the smaller pos."""
    n = kv.groupBy("stream_id").agg((F.max("pos") + 1).alias("n"))
    pooled = votes(kv, late, scale, dim).withColumn("pooled", A.sliding_max(F.col("vote"), pool, "stream_id")).join(small(n, 32), "stream_id")
    always = (F.col("pos") < sink) | (F.col("pos") >= F.col("n") - tail)
    w = Window.partitionBy("stream_id").orderBy(F.when(always, 0).otherwise(1), F.desc("pooled"), "pos")
    return pooled.withColumn("_r", F.row_number().over(w)).filter(always | (F.col("_r") <= tokens)).select("stream_id", "pos")


def evicted_pages(kv: DataFrame, kept: DataFrame, dim: int, dim_value: int) -> DataFrame:
    """(stream_id, page, n, key, value): mean key and value of the tokens of each page that aren't kept; pages kept whole aren't there."""
    gone = kv.join(kept, ["stream_id", "pos"], "left_anti")
    return gone.groupBy("stream_id", page().alias("page")).agg(F.count("*").alias("n"), V.mean_by_dim(V.doubles(F.col("key")), dim).alias("key"), V.mean_by_dim(F.col("value"), dim_value).alias("value"))


def evicted_background(queries: DataFrame, kv: DataFrame, kept: DataFrame, scale: float, dim: int, dim_value: int) -> DataFrame:
    """Kept tokens exactly; what is gone as one row a page: its mean key's logit plus the logarithm of its number, with its mean value."""
    hit = A.exact(queries, kv.join(kept, ["stream_id", "pos"], "left_semi"), scale, dim).select("query_id", "logit", "value")
    rest = A.exact(queries, evicted_pages(kv, kept, dim, dim_value), scale, dim).select("query_id", (F.col("logit") + F.log("n")).alias("logit"), "value")
    return A.combine(A.softmax(hit.unionByName(rest)), dim_value)


def anchors(rows: DataFrame, count: int, local: int) -> DataFrame:
    """Of rows(stream_id, pos, n, ...), n being the stream's length, `count` evenly spaced ones, both ends included, and the last `local` (256 at most)."""
    step = F.greatest((F.col("n") - 1) / F.lit(max(1, count - 1)), F.lit(1.0))
    near = F.floor(F.col("pos") / step + 0.5)
    even = (near < count) & (F.floor(near * step + 0.5) == F.col("pos"))
    return rows.filter((F.col("pos") >= F.col("n") - F.lit(min(256, local))) | even)


def nearest_keys(anchored: DataFrame, kv: DataFrame, k: int, dim: int) -> DataFrame:
    """(query_id, stream_id, pos): each anchor query's k keys of largest product, ties to the smaller pos."""
    logits = A.exact(anchored, kv, 1.0, dim, ["pos"])
    w = Window.partitionBy("query_id").orderBy(F.desc("logit"), "pos")
    return logits.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).select("query_id", "stream_id", "pos")


def by_product(points: DataFrame, centroids: DataFrame, dim: int) -> DataFrame:
    """points(stream_id, key, ...) with list_id, the centroid of largest product, ties to the smaller list."""
    packed = centroids.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("list_id", F.col("centroid").alias("c")))).alias("_cs"))
    best = F.array_min(F.transform("_cs", lambda c: F.struct((-V.dot(V.doubles(F.col("key")), c["c"], dim)).alias("d"), c["list_id"].alias("l"))))
    lists = (centroids.agg(F.max("list_id")).first()[0] or 0) + 1
    return meet(points, packed, (8 * dim + 32) * lists).withColumn("list_id", best["l"]).drop("_cs")


def product_lists(kv: DataFrame, first: DataFrame, dim: int, rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """(centroids, kv with list_id): k-means by largest product from given centroids; a list without rows keeps its centroid."""
    centroids = first
    for _ in range(rounds):
        mean = by_product(kv, centroids, dim).groupBy("stream_id", "list_id").agg(V.mean_by_dim(V.doubles(F.col("key")), dim).alias("_m"))
        centroids = stash(centroids.join(mean, ["stream_id", "list_id"], "left").select("stream_id", "list_id", F.coalesce("_m", "centroid").alias("centroid")), "centroids")
    return centroids, by_product(kv, centroids, dim)


def anchored_candidates(queries: DataFrame, anchored: DataFrame, kv: DataFrame, first: DataFrame, dim: int, knn: int, near: int, nprobe: int, list_cap: int, cap: int) -> DataFrame:
    """(query_id, stream_id, pos) for each query: the knn keys of its `near` anchors of largest product, and the first list_cap // nprobe rows of its nprobe lists of
    largest product; each row once, and of those the first `cap` by position."""
    linked = stash(nearest_keys(anchored, kv, knn, dim), "links").withColumnRenamed("query_id", "anchor")
    asked = anchored.select(F.col("query_id").alias("pos"), "stream_id", F.col("q").alias("key"))
    w = Window.partitionBy("query_id").orderBy(F.desc("logit"), "pos")
    mine = A.exact(queries, asked, 1.0, dim, ["pos"]).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= near)
    mapped = mine.select("query_id", "stream_id", F.col("pos").alias("anchor")).join(linked, ["stream_id", "anchor"]).select("query_id", "stream_id", "pos")
    centroids, listed = product_lists(kv, first, dim)
    of_lists = A.exact(queries, centroids.select("stream_id", F.col("list_id").alias("pos"), F.col("centroid").alias("key")), 1.0, dim, ["pos"])
    probed = of_lists.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= nprobe).select("query_id", "stream_id", F.col("pos").alias("list_id"))
    order = Window.partitionBy("stream_id", "list_id").orderBy("pos")
    head = listed.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= max(1, list_cap // max(1, nprobe))).select("stream_id", "list_id", "pos")
    found = mapped.unionByName(head.join(small(stash(probed, "probes"), 32), ["stream_id", "list_id"]).select("query_id", "stream_id", "pos")).distinct()
    place = Window.partitionBy("query_id").orderBy("pos")
    return found.withColumn("_r", F.row_number().over(place)).filter(F.col("_r") <= cap).drop("_r")


def anchored_attention(queries: DataFrame, regions: DataFrame, candidates: DataFrame, k: int, scale: float, dim: int, dim_value: int) -> DataFrame:
    """(query_id, d, value): attention over sink and local rows, and over the k best candidates by exact logit, merged by their logarithms of sums."""
    rows = regions.filter("region = 'retrieval'").select("stream_id", "pos", "key", "value").join(candidates, ["stream_id", "pos"])
    held = small(queries.select("query_id", V.doubles(F.col("q")).alias("_q")), 8 * dim + 32)
    found = rows.join(held, "query_id").select("query_id", "pos", (V.dot(F.col("_q"), V.doubles(F.col("key")), dim) * F.lit(scale)).alias("logit"), "value")
    w = Window.partitionBy("query_id").orderBy(F.desc("logit"), "pos")
    best = found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).select("query_id", "logit", "value", F.lit("found").alias("part"))
    always = A.exact(queries, regions.filter("region <> 'retrieval'"), scale, dim).select("query_id", "logit", "value", F.lit("static").alias("part"))
    return A.merge_partial(A.partial(always.unionByName(best), "part", dim_value), dim_value)


#: Weights of the tiers, and the share of the window up to which each goes (fixed values).
TIERS = ((6, 0.05), (5, 0.15), (4, 0.30), (3, 0.50), (2, 0.75), (1, 1.00))
#: Share of keys a sub-space that score; share of keys kept as candidates; seed of the rotation (fixed values).
RHO, BETA, TURN_SEED = 0.30, 0.08, 20260918


def turned_pieces(v: Column, dim: int, turn: np.ndarray) -> Column:
    """The vector at unit length, rotated."""
    return V.rotate(V.direction(V.doubles(v), dim), turn)


def collisions(queries: DataFrame, kv: DataFrame, dim: int, pieces: int, turn: np.ndarray, rho: float = RHO) -> DataFrame:
    """(query_id, stream_id, pos, score): for each sub-space of the rotated unit vectors, keys are ranked by the product of the query's piece with the signs of the
    key's piece. The best ceil(rho * n) score, by tier of their rank within that window; points sum up. Products are rounded to nine places, ties go to the smaller
    pos."""
    size = dim // pieces
    rows = meet(kv.select("stream_id", "pos", turned_pieces(F.col("key"), dim, turn).alias("_k")), queries.select("query_id", "stream_id", turned_pieces(F.col("q"), dim, turn).alias("_q")), 8 * dim + 32)
    sign = lambda i: F.when(F.get("_k", F.lit(i)) >= 0, 1.0).otherwise(-1.0)
    one = lambda m: F.round(sum(F.get("_q", F.lit(i)) * sign(i) for i in range(m * size, (m + 1) * size)), 9)
    long = rows.select("query_id", "stream_id", "pos", F.posexplode(F.array(*(one(m) for m in range(pieces)))).alias("m", "x"))
    n = small(kv.groupBy("stream_id").agg(F.count("*").alias("_n")), 32)
    window = F.greatest(F.lit(1), F.least(F.col("_n"), F.ceil(F.lit(rho) * F.col("_n"))))
    place = F.row_number().over(Window.partitionBy("query_id", "m").orderBy(F.desc("x"), "pos"))
    points = F.lit(0)
    for worth, share in reversed(TIERS):
        points = F.when(F.col("_r") <= F.least(F.col("_w"), F.ceil(F.lit(share) * F.col("_w"))), worth).otherwise(points)
    ranked = long.withColumn("_r", place).join(n, "stream_id").withColumn("_w", window)
    return ranked.groupBy("query_id", "stream_id", "pos").agg(F.sum(points).alias("score"))


def lloyd_max(dim: int, levels: int = 8, rounds: int = 40, samples: int = 1 << 16, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Levels and thresholds of the scalar quantizer of the size of a component of a random unit vector, by Lloyd's rounds on a seeded sample (on the driver)."""
    x = np.random.default_rng([seed, dim]).standard_normal((samples, dim))
    x = np.sort(np.abs(x / np.linalg.norm(x, axis=1, keepdims=True)).ravel())
    level = np.quantile(x, np.linspace(0.5 / levels, 1 - 0.5 / levels, levels))
    for _ in range(rounds):
        parts = np.split(x, np.searchsorted(x, (level[1:] + level[:-1]) / 2, "right"))
        level = np.array([p.mean() if len(p) else o for p, o in zip(parts, level, strict=True)])
    return level, (level[1:] + level[:-1]) / 2


def quantized(v: Column, level: np.ndarray, edge: np.ndarray) -> Column:
    """Each component's sign times the level of its size."""
    return F.transform(v, lambda x: F.when(x >= 0, 1.0).otherwise(-1.0) * _steps(F.abs(x), level, edge))


def _steps(x: Column, level: np.ndarray, edge: np.ndarray) -> Column:
    out = F.lit(float(level[-1]))
    for lv, e in zip(level[-2::-1], edge[::-1], strict=True):
        out = F.when(x <= float(e), float(lv)).otherwise(out)
    return out


def reranked(queries: DataFrame, kv: DataFrame, scores: DataFrame, k: int, dim: int, pieces: int, turn: np.ndarray, level: np.ndarray, edge: np.ndarray, beta: float = BETA) -> DataFrame:
    """(query_id, stream_id, pos, score, approx, rank): of the max(k, ceil(beta * n)) best by collisions, ties to the smaller pos, the best k by estimated product.

    The estimate sums, over sub-spaces, the piece's length times the query's product with the piece's quantized direction, over their agreement; and takes that
    times the key's length. Of k rows or fewer all are chosen.
    """
    size = dim // pieces
    n = small(kv.groupBy("stream_id").agg(F.count("*").alias("_n")), 32)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    held = scores.withColumn("_r", F.row_number().over(w)).join(n, "stream_id").filter(F.col("_r") <= F.greatest(F.lit(k), F.ceil(F.lit(beta) * F.col("_n"))))
    rows = held.drop("_r", "_n").join(kv.select("stream_id", "pos", turned_pieces(F.col("key"), dim, turn).alias("_k"), V.norm(V.doubles(F.col("key")), dim).alias("_l")), ["stream_id", "pos"])
    rows = rows.join(small(queries.select("query_id", turned_pieces(F.col("q"), dim, turn).alias("_q")), 8 * dim + 32), "query_id")
    total = F.lit(0.0)
    for m in range(pieces):
        u, v = f"_u{m}", f"_v{m}"
        rows = rows.withColumn(u, V.piece(F.col("_k"), m, size)).withColumn(f"_r{m}", F.sqrt(V.dot(F.col(u), F.col(u), size)))
        rows = rows.withColumn(u, V.direction(F.col(u), size)).withColumn(v, quantized(F.col(u), level, edge))
        rows = rows.withColumn(v, V.direction(F.col(v), size))
        agree = F.greatest(V.dot(F.col(u), F.col(v), size), F.lit(1e-3))
        total = total + F.col(f"_r{m}") * V.dot(V.piece(F.col("_q"), m, size), F.col(v), size) / agree
    rows = rows.select("query_id", "stream_id", "pos", "score", F.round(total * F.col("_l"), 9).alias("approx"))
    best = Window.partitionBy("query_id").orderBy(F.desc("approx"), "pos")
    return rows.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)


def collided(queries: DataFrame, regions: DataFrame, k: int, dim: int, pieces: int, turn: np.ndarray | None = None) -> DataFrame:
    """(query_id, stream_id, pos, score, approx, rank): the rule of collisions() and reranked() on the retrieval rows, by blocks and counts of codes; pieces of over eight
    components have too many codes to count, and take the plain way."""
    turn = V.rotation(dim, TURN_SEED) if turn is None else turn
    size, (level, edge) = dim // pieces, lloyd_max(dim // pieces)
    if size > 8:
        rows = regions.filter("region = 'retrieval'").select("stream_id", "pos", "key")
        return reranked(queries, rows, collisions(queries, rows, dim, pieces, turn), k, dim, pieces, turn, level, edge)
    held = regions.filter("region = 'retrieval'").select("stream_id", "pos", turned_pieces(F.col("key"), dim, turn).alias("_k"), V.norm(V.doubles(F.col("key")), dim).alias("_l"))
    bit = lambda i, j: F.when(F.get("_k", F.lit(i)) >= 0, 1 << j).otherwise(0)
    code = F.array(*(sum((bit(m * size + j, j) for j in range(1, size)), bit(m * size, 0)) for m in range(pieces)))
    rows = stash(held.withColumn("code", code), "pieces")
    for m in range(pieces):
        u, v = f"_u{m}", f"_v{m}"
        rows = rows.withColumn(u, V.piece(F.col("_k"), m, size)).withColumn(f"_r{m}", F.sqrt(V.dot(F.col(u), F.col(u), size)))
        rows = rows.withColumn(u, V.direction(F.col(u), size)).withColumn(v, V.direction(quantized(F.col(u), level, edge), size))
        agree = F.greatest(V.dot(F.col(u), F.col(v), size), F.lit(1e-3))
        rows = rows.withColumn(v, V.times(F.col(v), F.col(f"_r{m}") / agree * F.col("_l")))
    w, ok = blocks.whole(F.flatten(F.array(*(F.col(f"_v{m}") for m in range(pieces)))), dim)
    q, asks = blocks.whole(turned_pieces(F.col("q"), dim, turn), dim)
    asked = stash(queries.select("stream_id", "query_id", q.alias("q"), asks.alias("ok")), "asked")
    found = blocks.collided(asked, rows.select("stream_id", "pos", "code", w.alias("w"), ok.alias("ok")), k, dim, pieces, TIERS, RHO, BETA)
    best = Window.partitionBy("query_id").orderBy(F.desc("approx"), "pos")
    return found.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)


def selected_attention(queries: DataFrame, regions: DataFrame, chosen: DataFrame, scale: float, dim: int, dim_value: int) -> DataFrame:
    """(query_id, d, value): exact softmax over sink, chosen(query_id, stream_id, pos) and local rows; nothing stands for the rest."""
    rows = regions.select("stream_id", "pos", "key", "value").join(small(chosen.select("query_id", "stream_id", "pos"), 32), ["stream_id", "pos"])
    held = small(queries.select("query_id", V.doubles(F.col("q")).alias("_q")), 8 * dim + 32)
    picked = rows.join(held, "query_id").select("query_id", (V.dot(F.col("_q"), V.doubles(F.col("key")), dim) * F.lit(scale)).alias("logit"), "value")
    always = A.exact(queries, regions.filter("region <> 'retrieval'"), scale, dim).select("query_id", "logit", "value")
    return A.combine(A.softmax(always.unionByName(picked)), dim_value)


def selector_stats(queries: DataFrame, regions: DataFrame, chosen: DataFrame, pieces: int, k: int) -> DataFrame:
    """(n_records, skipped_share, mean_budget, mean_collision_share): over all queries, the share whose retrieval rows are k or fewer, the rows that they attend to,
    and the points of their chosen rows as a share of the most there can be."""
    n = regions.groupBy("stream_id").agg(F.count_if(F.col("region") == "retrieval").alias("_zone"), F.count_if(F.col("region") != "retrieval").alias("_always"))
    per = chosen.groupBy("query_id").agg(F.avg("score").alias("_mean"))
    rows = queries.select("query_id", "stream_id").join(small(n, 32), "stream_id").join(per, "query_id", "left")
    skipped = F.col("_zone") <= k
    most = sum(w for w, _ in TIERS) * pieces
    return rows.agg(
        F.count("*").alias("n_records"),
        F.avg(skipped.cast("double")).alias("skipped_share"),
        F.avg(F.col("_always") + F.least(F.col("_zone"), F.lit(k))).alias("mean_budget"),
        F.avg(F.when(~skipped, F.col("_mean") / most)).alias("mean_collision_share"),
    )


def share_of_mass(weights: DataFrame) -> DataFrame:
    """(query_id, share): softmax mass of the chosen rows, from 0 to 1."""
    share = F.sum(F.when(F.col("chosen"), F.col("w")).otherwise(0.0)) / F.sum("w")
    return weights.groupBy("query_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)).alias("share"))
