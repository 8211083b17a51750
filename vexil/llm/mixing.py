"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source; a source's repetition rate is its target over its size; each document is emitted floor(rate) times, plus once more
with a probability of the rate's fraction, by a draw that is a hash of seed and document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexil.llm.common import WORD, maybe_broadcast, stash

WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1): the first 48 bits of MD5 of seed and document id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) for a table (source, source_size) of a row a source.

    A target is weight times a common level, or the cap `most * source_size` where that is less. Capped sources are those with the least cap a weight. In that
    order the level left to a source and those after it rises while the source is capped and falls from the first that isn't: the largest such level is the one. So
    running sums do without iteration. If all are capped, targets are the caps; sizes of zero get a target of zero.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("x", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("want") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("w_all") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    return (
        sizes.withColumn("w", weight)
        .withColumn("cap", F.col("source_size") * F.lit(most))
        .withColumn("x", F.col("cap") / F.col("w"))
        .withColumn("want", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("w_all", F.sum("w").over(every))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("x") >= F.col("level"), F.col("level"))).over(every))
        .select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("level"))).alias("target"))
    )


def _copies(doc_id: Column, seed: str) -> Column:
    """floor(rate) copies and one more by draw, for rows that have source_size and target."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (F.floor(rate) + F.when(draw(doc_id, seed) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _with_targets(rows: DataFrame, per: DataFrame) -> DataFrame:
    """rows(source, ...) joined with the table of sources: broadcast only if its counted rows fit; else shuffled, and AQE splits a hot source."""
    side = maybe_broadcast(per, per.count(), 200).withColumnRenamed("source", "_source")
    return rows.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def plan(docs: DataFrame, seed: str = "mix", share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often the mix takes each row of docs(doc_id, text, source).

    Sizes are written once to the shared folder, so the text is read once. A null text has size 0; null sources are one source, last; repeated doc_ids share a
    draw. Sources of size 0 have rate 0. An empty table gives no rows.
    """
    sized = stash(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    per = stash(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights), "targets")
    return _with_targets(sized, per).withColumn("copies", _copies(F.col("doc_id"), seed))


def mix(docs: DataFrame, seed: str = "mix", share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, number: str | None = "copy_no") -> DataFrame:
    """docs with each row as often as the plan takes it, the copy's number (from 0) in column `number`; rows that it doesn't take are gone.

    Rows are emitted where they are read: only sums per source are shuffled.
    """
    sums = docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    per = stash(targets(sums, share, most, weights), "targets")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "source")
    taken = _with_targets(rows, per).withColumn("copies", _copies(F.col("row.doc_id"), seed)).filter("copies > 0")
    taken = taken.select("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("no"))
    return taken.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != number), *([F.col("no").alias(number)] if number else []))
