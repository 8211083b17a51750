"""Sparse and hybrid softmax over regions of a sequence: exact rows, selected rows, and approximate mass a list.

Tables in long form: logits(query_id, pos, region, list_id, logit, chosen); weights add w; outputs are (query_id, d, value).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexil.functions import vectors as V
from vexil.operators import blocks
from vexil.operators import search as S
from vexil.operators.config import AttentionConfig
from vexil.operators.ivf import Index
from vexil.sources.shared import meet, small, stash


def regions(kv: DataFrame, sink: int, local: int) -> DataFrame:
    """kv(stream_id, pos, ...) with region: sink, then retrieval, then local; the local rows are the last ones that aren't sink."""
    n = kv.groupBy("stream_id").agg((F.max("pos") + 1).alias("_n"))
    start = F.greatest(F.least(F.lit(sink), F.col("_n")), F.col("_n") - local)
    region = F.when(F.col("pos") < sink, "sink").when(F.col("pos") >= start, "local").otherwise("retrieval")
    return kv.join(small(n, 32), "stream_id").withColumn("region", region).drop("_n")


def exact(queries: DataFrame, kv: DataFrame, scale: float, dim: int, keep: list[str] | None = None) -> DataFrame:
    """(query_id, pos, ..., logit): scaled products of each query with all keys of its stream; the queries go to the keys."""
    held = queries.select("query_id", "stream_id", V.doubles(F.col("q")).alias("_q"))
    cols = [c for c in (keep if keep is not None else kv.columns) if c not in ("key", "stream_id")]
    met = meet(kv, held, 8 * dim + 32, "pos" if "pos" in kv.columns else "key")
    return met.select("query_id", "stream_id", *cols, (V.dot(F.col("_q"), V.doubles(F.col("key")), dim) * F.lit(scale)).alias("logit"))


def _beside(rows: DataFrame, table: DataFrame, by: list[str], row_bytes: int = 64) -> DataFrame:
    """rows with the columns of a table of a row a group; null groups meet too."""
    named = small(table, row_bytes).withColumnsRenamed({b: f"_by_{b}" for b in by})
    same = reduce(and_, (F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by))
    return rows.join(named, same).drop(*(f"_by_{b}" for b in by))


def totals(logits: DataFrame, by: list[str]) -> DataFrame:
    """(by..., _m, _s): the largest logit of each group and the sum of exp(logit - _m), as a written table of a row a group.

    Two aggregates, each partial in every task: no group's rows are gathered or sorted.
    """
    largest = stash(logits.groupBy(*by).agg(F.max("logit").alias("_m")), "largest")
    shifted = _beside(logits.select(*by, "logit"), largest, by)
    return stash(shifted.groupBy(*by).agg(F.max("_m").alias("_m"), F.sum(F.exp(F.col("logit") - F.col("_m"))).alias("_s")), "totals")


def softmax(logits: DataFrame) -> DataFrame:
    """logits with w, their share in the softmax of their query."""
    return _beside(logits, totals(logits, ["query_id"]), ["query_id"]).withColumn("w", F.exp(F.col("logit") - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def combine(weights: DataFrame, dim: int, value: str = "value") -> DataFrame:
    """(query_id, d, value): weighted sums of the value vectors."""
    sums = F.array(*(F.sum(F.col("w") * F.get(F.col(value), F.lit(i))) for i in range(dim)))
    return weights.groupBy("query_id").agg(sums.alias("_o")).select("query_id", F.posexplode("_o").alias("d", "value")).select("query_id", F.col("d").cast("long").alias("d"), "value")


def dense(queries: DataFrame, kv: DataFrame, scale: float, dim: int, dim_value: int) -> DataFrame:
    """Softmax over all rows, by blocks: a query's rows meet it as matrices, and a row a block is merged."""
    return merge_partial(blocks.partial(queries, kv, scale, dim, dim_value), dim_value)


def segment_sums(logits: DataFrame) -> DataFrame:
    """(query_id, list_id, s): sums of exp(logit - the query's largest logit)."""
    largest = stash(logits.groupBy("query_id").agg(F.max("logit").alias("_m")), "largest")
    return _beside(logits, largest, ["query_id"]).groupBy("query_id", "list_id").agg(F.sum(F.exp(F.col("logit") - F.col("_m"))).alias("s"))


def segment_stats(logits: DataFrame, by: list[str]) -> DataFrame:
    """(by..., m, s): the largest logit of a segment and the sum of exp(logit - m); such rows of parts merge by merge_stats()."""
    return totals(logits, by).withColumnsRenamed({"_m": "m", "_s": "s"})


def merge_stats(parts: DataFrame, by: list[str]) -> DataFrame:
    """Parts (by..., m, s) folded to one row a group, rescaled to the common largest logit; an empty part is (-inf, 0)."""
    largest = stash(parts.groupBy(*by).agg(F.max("m").alias("_m")), "largest")
    scaled = F.when(F.col("s") == 0, 0.0).otherwise(F.col("s") * F.exp(F.col("m") - F.col("_m")))
    return _beside(parts, largest, by).groupBy(*by).agg(F.max("_m").alias("m"), F.sum(scaled).alias("s"))


def partial(logits: DataFrame, part: str, dim: int) -> DataFrame:
    """(query_id, part, m, s, o): attention over a part of the rows: its largest logit, its sum, and its weighted values, not yet divided."""
    by = ["query_id", part]
    largest = stash(logits.groupBy(*by).agg(F.max("logit").alias("_m")), "largest")
    shifted = _beside(logits, largest, by).withColumn("_e", F.exp(F.col("logit") - F.col("_m")))
    sums = F.array(*(F.sum(F.col("_e") * F.get("value", F.lit(i))) for i in range(dim)))
    return shifted.groupBy("query_id", F.col(part).alias("part")).agg(F.max("_m").alias("m"), F.sum("_e").alias("s"), sums.alias("o"))


def merge_partial(parts: DataFrame, dim: int) -> DataFrame:
    """(query_id, d, value) of parts, by their logarithms of sums; parts are a few rows a query, written first."""
    parts = stash(parts, "parts")
    shifted = _beside(parts, parts.groupBy("query_id").agg(F.max("m").alias("_m")), ["query_id"]).withColumn("_f", F.exp(F.col("m") - F.col("_m")))
    total = F.sum(F.col("s") * F.col("_f"))
    out = F.array(*((F.sum(F.get("o", F.lit(i)) * F.col("_f")) / total) for i in range(dim)))
    return shifted.groupBy("query_id").agg(out.alias("_o")).select("query_id", F.posexplode("_o").alias("d", "value")).select("query_id", F.col("d").cast("long").alias("d"), "value")


def chosen_counts(scaled: DataFrame, lengths: DataFrame, cfg: AttentionConfig, prefix: DataFrame | None = None) -> DataFrame:
    """(query_id, k) for scaled(query_id, pos, score): by mass, or by a fraction of lengths(query_id, n) or the fixed number; from 0 to n.

    prefix(query_id, pos, logit): the always exact rows, for top_p_scope denominator: their mass counts before any row is chosen.
    """
    if cfg.top_p is not None:
        logits = scaled.select("query_id", "pos", F.col("score").alias("logit"))
        if cfg.top_p_scope == "retrieval":
            return S.nucleus(logits, cfg.top_p)
        both = softmax(logits.withColumn("_pre", F.lit(False)).unionByName(prefix.select("query_id", "pos", "logit").withColumn("_pre", F.lit(True))))
        ahead = stash(both.groupBy("query_id").agg(F.sum(F.when(F.col("_pre"), F.col("w")).otherwise(0.0)).alias("_ahead")), "ahead")
        return S.nucleus(_beside(both.filter("not _pre"), ahead, ["query_id"]).withColumn("mass", F.col("w")), cfg.top_p, F.col("_ahead"))
    k = S.fraction_k(F.col("n"), cfg.top_fraction) if cfg.top_fraction is not None else F.least(F.col("n"), F.lit(cfg.retrieval_topk))
    return lengths.select("query_id", k.alias("k"))


def hybrid_logits(queries: DataFrame, kv: DataFrame, index: Index, cfg: AttentionConfig, dim: int) -> DataFrame:
    """(query_id, pos, region, list_id, logit, chosen, value): one row for each row of the denominator.

    Sink and local rows and the chosen retrieval rows have exact logits; other retrieval rows have their approximate score times the scale. Which and how many
    are chosen follows approximate scores alone. kv has regions; a query of a stream without retrieval rows keeps its sink and local rows.

    Keys are multiplied for sink, local and chosen rows only. The others carry no value (null), unless the configuration sums all values, and aren't joined with
    anything but a row a query: the last chosen one's place tells which rows come after it.
    """
    scale = cfg.scaled(dim)
    probed = None
    if cfg.topk_source == "ivf_candidates" or cfg.denominator_source == "ivf_candidates":
        probed = S.candidates(S.probes(queries, index, cfg.nprobe or index.config.nprobe), index, queries)
    full = S.approximate(queries, index) if cfg.denominator_source == "all_pq" else S.score_candidates(probed, queries, index)
    if cfg.denominator_source == "ivf_candidates" and cfg.candidate_budget is not None:
        full = S.top(full, max(cfg.candidate_budget, cfg.retrieval_topk)).drop("rank")
    scaled = full.withColumn("score", F.col("score") * F.lit(scale))
    pool = scaled
    if cfg.topk_source == "ivf_candidates" and cfg.denominator_source == "all_pq":
        pool = scaled.join(probed.select("query_id", "pos"), ["query_id", "pos"], "left_semi")
        if cfg.candidate_budget is not None:
            pool = S.top(pool, cfg.candidate_budget).drop("rank")
    always = exact(queries, kv.filter("region <> 'retrieval'"), scale, dim)
    lengths = queries.select("query_id", "stream_id").join(index.codes.groupBy("stream_id").agg(F.count("*").alias("n")), "stream_id")
    k = stash(chosen_counts(scaled, lengths, cfg, always), "counts")
    most = k.agg(F.max("k")).first()[0] or 0
    best = _beside(S.top(pool, most), k, ["query_id"]).filter(F.col("rank") <= F.col("k")).select("query_id", "stream_id", "pos", "list_id", "score")
    best = stash(best, "chosen")
    place = F.struct("score", -F.col("pos"))
    if pool is scaled:
        last = best.groupBy("query_id").agg(F.min(place).alias("_last"))
        rest = scaled.join(small(last, 32), "query_id", "left").filter(F.col("_last").isNull() | (place < F.col("_last")))
    else:
        rest = scaled.join(best.select("query_id", "pos"), ["query_id", "pos"], "left_anti")
    asked = small(queries.select("query_id", V.doubles(F.col("q")).alias("_q")), 8 * dim + 32)
    rows = kv.select("stream_id", "pos", "key", "value")
    chosen = rows.join(small(best, 48), ["stream_id", "pos"])
    logit = V.dot(F.col("_q"), V.doubles(F.col("key")), dim) * F.lit(scale) if cfg.exact_rerank else F.col("score")
    chosen = chosen.join(asked, "query_id").withColumn("logit", logit).withColumn("chosen", F.lit(True))
    rest = rest.withColumn("logit", F.col("score")).withColumn("chosen", F.lit(False))
    if cfg.mode == "hybrid" and cfg.value_mode == "full":
        rest = rest.join(rows.select("stream_id", "pos", "value"), ["stream_id", "pos"])
    else:
        rest = rest.withColumn("value", F.lit(None).cast(kv.schema["value"].dataType))
    cols = ["query_id", "stream_id", "pos", "region", "list_id", "logit", "chosen", "value"]
    found = chosen.select(*(c for c in cols if c != "region")).unionByName(rest.select(*(c for c in cols if c != "region"))).withColumn("region", F.lit("retrieval"))
    return always.withColumn("list_id", F.lit(None).cast("int")).withColumn("chosen", F.lit(True)).select(cols).unionByName(found.select(cols))


def attend(logits: DataFrame, cfg: AttentionConfig, dim_value: int, means: DataFrame | None = None, mean: str = "v_mean") -> DataFrame:
    """(query_id, d, value) of hybrid_logits().

    sparse: softmax over chosen rows only. hybrid: one softmax over all rows; then `denominator` sums chosen rows, `full` sums all, `centroid` sums chosen rows
    and adds the mass of the others a list times that list's mean value, means(stream_id, list_id, v_mean).
    """
    if cfg.mode == "sparse":
        return combine(softmax(logits.filter("chosen")), dim_value)
    weights = softmax(logits)
    if cfg.value_mode == "full":
        return combine(weights, dim_value)
    direct = combine(weights.filter("chosen"), dim_value)
    if cfg.value_mode == "denominator":
        return direct
    return added(direct, background(weights, means, dim_value, mean))


def list_mass(weights: DataFrame) -> DataFrame:
    return weights.filter("not chosen").groupBy("query_id", "stream_id", "list_id").agg(F.sum("w").alias("w"))


def background(weights: DataFrame, means: DataFrame, dim: int, mean: str = "v_mean") -> DataFrame:
    """Mass a list times its mean value, summed."""
    return combine(list_mass(weights).join(small(means.select("stream_id", "list_id", F.col(mean).alias("value")), 1024), ["stream_id", "list_id"]), dim)


def added(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("query_id", "d").agg(F.sum("value").alias("value"))


def corrected(queries: DataFrame, kv: DataFrame, index: Index, cfg: AttentionConfig, dim: int) -> DataFrame:
    """(query_id, total, background): the denominator and the mass left to the lists, by correction: all approximate terms, less those of chosen rows, plus exact
    ones. Equal to summing hybrid_logits(); kept to test that."""
    scale = cfg.scaled(dim)
    scores = S.approximate(queries, index).withColumn("score", F.col("score") * F.lit(scale))
    logits = hybrid_logits(queries, kv, index, cfg, dim)
    top_ = logits.groupBy("query_id").agg(F.max("logit").alias("m"))
    old = logits.filter("chosen and region = 'retrieval'").select("query_id", "pos").join(scores, ["query_id", "pos"])
    held = scores.join(top_, "query_id").groupBy("query_id").agg(F.sum(F.exp(F.col("score") - F.col("m"))).alias("all"))
    gone = old.join(top_, "query_id").groupBy("query_id").agg(F.sum(F.exp(F.col("score") - F.col("m"))).alias("old"))
    new = logits.filter("chosen").join(top_, "query_id").groupBy("query_id").agg(F.sum(F.exp(F.col("logit") - F.col("m"))).alias("new"))
    left = F.greatest(F.col("all") - F.coalesce("old", F.lit(0.0)), F.lit(0.0))
    return held.join(gone, "query_id", "left").join(new, "query_id").select("query_id", (left + F.col("new")).alias("total"), left.alias("background"))


def stats(logits: DataFrame) -> DataFrame:
    """(query_id, n_sink, n_local, n_chosen, n_background, exact_share)."""
    count = lambda c: F.count_if(c)
    out = logits.groupBy("query_id").agg(
        count(F.col("region") == "sink").alias("n_sink"),
        count(F.col("region") == "local").alias("n_local"),
        count((F.col("region") == "retrieval") & F.col("chosen")).alias("n_chosen"),
        count(~F.col("chosen")).alias("n_background"),
        F.count("*").alias("_n"),
    )
    return out.withColumn("exact_share", (F.col("_n") - F.col("n_background")) / F.greatest(F.lit(1), F.col("_n"))).drop("_n")


# heads


def head_queries(queries: DataFrame, group: int) -> DataFrame:
    """queries(query_id, q_head, q) with stream_id, the key/value head that a group of `group` query heads shares."""
    return queries.withColumn("stream_id", F.floor(F.col("q_head") / group).cast("long"))


def split_heads(rows: DataFrame, column: str, heads: int, size: int) -> DataFrame:
    """A row a head: (..., head, column) with column cut into equal vectors."""
    parts = F.array(*(V.piece(F.col(column), h, size) for h in range(heads)))
    return rows.select(*[c for c in rows.columns if c != column], F.posexplode(parts).alias("head", column))


def merge_heads(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("head", column))), lambda e: e[column])).alias(column))


def sliding_max(column: Column, width: int, *by: str) -> Column:
    """The largest of width values around each, by pos."""
    half = width // 2
    return F.max(column).over(Window.partitionBy(*by).orderBy("pos").rowsBetween(-half, half))
