"""What is made of scores: means, paired comparisons with a stratified bootstrap, comparisons of decodings, recall, timings."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED, REPLICATES = 20260828, 10_000


def macro_mean(scores: DataFrame) -> DataFrame:
    """(method, macro, tasks): the unweighted mean over tasks of each task's mean, for scores(method, task, score)."""
    return scores.groupBy("method", "task").agg(F.avg("score").alias("m")).groupBy("method").agg(F.avg("m").alias("macro"), F.count("*").alias("tasks"))


def mean_std(values: DataFrame, by: str, column: str) -> DataFrame:
    """Mean and sample deviation, 0 for one value, NaN for none that isn't null."""
    n = F.count(column)
    std = F.when(n == 0, F.lit(float("nan"))).otherwise(F.coalesce(F.nullif(F.stddev_samp(column), F.lit(float("nan"))), F.lit(0.0)))
    return values.groupBy(by).agg(F.when(n == 0, F.lit(float("nan"))).otherwise(F.avg(column)).alias("mean"), std.alias("std"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(task, _id, a, b) of the samples that both have."""
    return a.select("task", "_id", F.col("score").alias("a")).join(b.select("task", "_id", F.col("score").alias("b")), ["task", "_id"])


def paired_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    """(task, n_paired, a_only, b_only, mean_a, mean_b, diff, nonzero)."""
    both = a.select("task", "_id", F.col("score").alias("a"), F.lit(1).alias("_a")).join(b.select("task", "_id", F.col("score").alias("b"), F.lit(1).alias("_b")), ["task", "_id"], "full")
    in_both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.groupBy("task").agg(
        F.count_if(in_both).alias("n_paired"),
        F.count_if(F.col("_b").isNull()).alias("a_only"),
        F.count_if(F.col("_a").isNull()).alias("b_only"),
        F.avg(F.when(in_both, F.col("a"))).alias("mean_a"),
        F.avg(F.when(in_both, F.col("b"))).alias("mean_b"),
        F.avg(F.when(in_both, F.col("a") - F.col("b"))).alias("diff"),
        F.count_if(in_both & (F.col("a") != F.col("b"))).alias("nonzero"),
    )


def _replicates(label: str, by_task: list[np.ndarray], seed: int, replicates: int) -> np.ndarray:
    """[replicates, tasks]: means of a resample of each task's differences, the task's size kept; tasks in order draw from one generator."""
    rng = np.random.default_rng([seed, zlib.crc32(label.encode())])
    out = np.empty((replicates, len(by_task)))
    for t, d in enumerate(by_task):
        for at in range(0, replicates, 500):
            n = min(500, replicates - at)
            out[at : at + n, t] = d[rng.integers(0, len(d), (n, len(d)))].mean(1)
    return out


def bootstrap(pairs: DataFrame, seed: int = SEED, replicates: int = REPLICATES) -> DataFrame:
    """(label, task, n, diff, low, high, se, contains_zero, nonzero): for pairs(label, task, _id, a, b), the mean difference of each task and, as task `macro`, their mean
    and, as task `weighted`, that of all samples, with percentile 95 % bounds and the deviation of the same replicates, and how many samples differ. A comparison is
    one group: its size is that of one evaluation."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        label = pdf["label"].iloc[0]
        pdf = pdf.sort_values(["task", "_id"])
        groups = [(t, (g["a"] - g["b"]).to_numpy(float)) for t, g in pdf.groupby("task")]
        reps = _replicates(label, [d for _, d in groups], seed, replicates)
        rows = [(t, d, d.mean(), reps[:, i]) for i, (t, d) in enumerate(groups)]
        every = np.concatenate([d for _, d in groups])
        rows.append(("macro", every, float(np.mean([d.mean() for _, d in groups])), reps.mean(1)))
        rows.append(("weighted", every, every.mean(), reps @ np.array([len(d) for _, d in groups]) / len(every)))
        out = []
        for task, d, diff, r in rows:
            low, high = np.percentile(r, [2.5, 97.5])
            out.append((label, task, len(d), diff, low, high, r.std(ddof=1), bool(low <= 0 <= high), int((d != 0).sum())))
        return pd.DataFrame(out, columns=["label", "task", "n", "diff", "low", "high", "se", "contains_zero", "nonzero"])

    return pairs.groupBy("label").applyInPandas(run, "label string, task string, n long, diff double, low double, high double, se double, contains_zero boolean, nonzero long")


def compare_logits(pairs: DataFrame) -> DataFrame:
    """(nll_ref, nll_test, ppl_ratio, kl, rel_l2, top1, top1_in_10) for pairs(step, token, ref, test, target): two sets of logits over the same tokens."""
    step = Window.partitionBy("step")

    def logp(c: str) -> Column:
        m = F.max(c).over(step)
        return F.col(c) - m - F.log(F.sum(F.exp(F.col(c) - m)).over(step))

    place = lambda c: F.row_number().over(step.orderBy(F.desc(c), "token"))
    rows = pairs.withColumn("_r", logp("ref")).withColumn("_t", logp("test")).withColumn("_m", F.max("ref").over(step)).withColumn("_n", F.max("test").over(step))
    rows = rows.withColumn("_pr", place("ref")).withColumn("_pt", place("test"))
    per = rows.groupBy("step").agg(
        F.sum(F.when(F.col("token") == F.col("target"), -F.col("_r"))).alias("nr"),
        F.sum(F.when(F.col("token") == F.col("target"), -F.col("_t"))).alias("nt"),
        F.sum(F.exp("_r") * (F.col("_r") - F.col("_t"))).alias("kl"),
        (F.sqrt(F.sum(F.pow(F.col("ref") - F.col("test"), 2))) / F.greatest(F.sqrt(F.sum(F.pow("ref", F.lit(2)))), F.lit(1e-12))).alias("l2"),
        F.max(((F.col("_pr") == 1) & (F.col("_pt") == 1)).cast("int")).alias("same"),
        F.max(((F.col("_pr") == 1) & (F.col("_pt") <= 10)).cast("int")).alias("in10"),
    )
    return _averaged(per)


def compare_parts(parts: DataFrame) -> DataFrame:
    """compare_logits() of what blocks.compared() makes: a row a step and block, folded a step."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        mr, mt = pdf["mr"].max(), pdf["mt"].max()
        er, et = np.exp(pdf["mr"] - mr), np.exp(pdf["mt"] - mt)
        lr, lt = mr + np.log((pdf["sr"] * er).sum()), mt + np.log((pdf["st"] * et).sum())
        best, at = np.concatenate(pdf["best"].tolist()), np.concatenate(pdf["at"].tolist())
        found = at[np.lexsort((at, -best))[:10]]
        top = pdf["first"].to_numpy()[np.lexsort((pdf["first"], -pdf["mr"]))[0]]
        l2 = np.sqrt(pdf["d2"].sum()) / max(np.sqrt(pdf["r2"].sum()), 1e-12)
        kl = (pdf["kl"] * er).sum() / (pdf["sr"] * er).sum() - lr + lt
        return pd.DataFrame({"step": [pdf["step"].iloc[0]], "nr": [lr - pdf["ref"].max()], "nt": [lt - pdf["test"].max()], "kl": [kl], "l2": [l2], "same": [int(top == found[0])], "in10": [int(top in found)]})

    per = parts.groupBy("step").applyInPandas(fold, "step long, nr double, nt double, kl double, l2 double, same int, in10 int")
    return _averaged(per.withColumns({c: F.nullif(F.col(c), F.lit(float("nan"))) for c in ("nr", "nt")}))


def _averaged(per: DataFrame) -> DataFrame:
    return per.agg(
        F.avg("nr").alias("nll_ref"),
        F.avg("nt").alias("nll_test"),
        F.exp(F.avg("nt") - F.avg("nr")).alias("ppl_ratio"),
        F.avg("kl").alias("kl"),
        F.avg("l2").alias("rel_l2"),
        F.avg("same").alias("top1"),
        F.avg("in10").alias("top1_in_10"),
    )


def recall(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): share of exact(query_id, pos) that is in found(query_id, pos)."""
    hit = exact.select("query_id", "pos").join(found.select("query_id", "pos", F.lit(1).alias("_f")).distinct(), ["query_id", "pos"], "left")
    return hit.groupBy("query_id").agg((F.count("_f") / F.lit(k)).alias("recall"))


def jaccard_steps(sets: DataFrame) -> DataFrame:
    """(stream_id, step, jaccard): of each step's set of positions with the step before; sets(stream_id, step, members)."""
    before = F.lag("members").over(Window.partitionBy("stream_id").orderBy("step"))
    both = sets.withColumn("_b", before).filter("_b is not null")
    return both.select("stream_id", "step", (F.size(F.array_intersect("members", "_b")) / F.greatest(F.lit(1), F.size(F.array_union("members", "_b")))).alias("jaccard"))


def spans(marks: DataFrame, by: str, name: str, at: Column) -> DataFrame:
    """(name, total, calls): gaps between consecutive marks of a group, summed by the name of the mark that begins the gap."""
    gap = F.lead(at).over(Window.partitionBy(by).orderBy(at, "event_id")) - at
    return marks.withColumn("_gap", gap).filter("_gap is not null").groupBy(name).agg(F.sum("_gap").alias("total"), F.count("*").alias("calls"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, infinite for b = 0."""
    return F.when(b == 0, F.lit(float("inf"))).otherwise(a / b)


def summary(runs: DataFrame) -> DataFrame:
    """A row a configuration for runs(name, step, ref_ms, test_ms, ref_nll, test_nll, kl, top1, n_tokens): totals, means, perplexities and their differences and ratios,
    and speed ratios (infinite where the test took no time)."""
    n = F.count("*")
    out = runs.groupBy("name").agg(
        n.alias("steps"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("ref_ms").alias("ref_ms"),
        F.sum("test_ms").alias("test_ms"),
        F.avg("ref_ms").alias("ref_ms_mean"),
        F.avg("test_ms").alias("test_ms_mean"),
        F.coalesce(F.stddev_samp("test_ms"), F.lit(0.0)).alias("test_ms_std"),
        F.avg("ref_nll").alias("ref_nll"),
        F.avg("test_nll").alias("test_nll"),
        F.avg("kl").alias("kl_mean"),
        F.max("kl").alias("kl_max"),
        F.avg("top1").alias("top1"),
    )
    out = out.withColumn("ref_ppl", F.exp("ref_nll")).withColumn("test_ppl", F.exp("test_nll"))
    out = out.withColumn("nll_delta", F.col("test_nll") - F.col("ref_nll")).withColumn("ppl_delta", F.col("test_ppl") - F.col("ref_ppl")).withColumn("ppl_ratio", ratio(F.col("test_ppl"), F.col("ref_ppl")))
    out = out.withColumn("speedup", ratio(F.col("ref_ms"), F.col("test_ms"))).withColumn("slowdown", ratio(F.col("test_ms"), F.col("ref_ms")))
    per = lambda ms: ratio(1000.0 * F.col("n_tokens"), F.col(ms))
    return out.withColumn("ref_tokens_a_second", per("ref_ms")).withColumn("test_tokens_a_second", per("test_ms"))


def gate(results: DataFrame, most_loss: float = -0.05, least_top1: float = 0.9) -> DataFrame:
    """(n, passed) for results(ref_hit, test_hit, ref_score, test_score, span_top1): both hit, little lost, key span agrees."""
    ok = F.col("ref_hit") & F.col("test_hit") & (F.col("test_score") - F.col("ref_score") >= most_loss) & (F.col("span_top1") >= least_top1)
    return results.agg(F.count("*").alias("n"), F.coalesce(F.every(ok), F.lit(False)).alias("passed"))


def rejected(requests: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(reason, n): the first rule that a request meets, or `admitted`."""
    out = F.lit("admitted")
    for name, rule in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return requests.groupBy(out.alias("reason")).agg(F.count("*").alias("n"))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Floating columns rounded, for writing a report."""
    return df.select(*(F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
