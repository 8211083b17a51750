"""k-means by squared L2 distance over keyed groups of vectors, and what is made of its assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexil.functions.vectors import dot, mean_by_dim
from vexil.sources.shared import small, stash


def first_rows(points: DataFrame, keys: list[str], k: int, order: Column | None = None) -> DataFrame:
    """(keys, list_id, centroid): of each group the first k points by `order` (pos by default) as starting centroids."""
    w = Window.partitionBy(*keys).orderBy(order if order is not None else F.col("pos"), "pos")
    ranked = points.withColumn("list_id", F.row_number().over(w) - 1).filter(F.col("list_id") < k)
    return ranked.select(*keys, F.col("list_id").cast("int").alias("list_id"), F.col("v").alias("centroid"))


def seeded_rows(points: DataFrame, keys: list[str], k: int, seed: int) -> DataFrame:
    """The same by a hash of seed and position: a draw without replacement that reruns alike. Groups of fewer than k points give fewer centroids."""
    return first_rows(points, keys, k, F.xxhash64("pos", F.lit(seed)))


def assign(points: DataFrame, centroids: DataFrame, keys: list[str], dim: int, name: str = "list_id") -> DataFrame:
    """points(keys, v, ...) with the nearest centroid's list_id, ties to the smaller one, by |c|^2 - 2 v.c.

    A group's centroids travel as one array to its points, so nothing is multiplied out into rows and no point is shuffled while the centroids are small.
    """
    packed = centroids.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("list_id", F.col("centroid").alias("c"), dot(F.col("centroid"), F.col("centroid"), dim).alias("cc")))).alias("_cs"))
    near = F.array_min(F.transform("_cs", lambda c: F.struct((c["cc"] - 2 * dot(F.col("v"), c["c"], dim)).alias("d"), c["list_id"].alias("l"))))
    lists = centroids.agg(F.max("list_id")).first()[0] or 0
    return points.join(small(packed, (16 * dim + 32) * (lists + 1)), keys).withColumn(name, near["l"]).drop("_cs")


def update(assigned: DataFrame, centroids: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """The mean of each list's points; a list without points keeps its centroid."""
    mean = assigned.groupBy(*keys, "list_id").agg(mean_by_dim(F.col("v"), dim).alias("_mean"))
    return centroids.join(mean, [*keys, "list_id"], "left").select(*keys, "list_id", F.coalesce("_mean", "centroid").alias("centroid"))


def reseed(assigned: DataFrame, updated: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Lists without points get a point of their group instead, drawn by a hash of seed, list and position."""
    used = assigned.select(*keys, "list_id").distinct()
    empty = updated.join(used, [*keys, "list_id"], "left_anti")
    if empty.isEmpty():
        return updated
    draw = assigned.select(*keys, "pos", "v").join(small(empty.select(*keys, "list_id"), 32), keys)
    drawn = draw.groupBy(*keys, "list_id").agg(F.min_by("v", F.xxhash64("pos", "list_id", F.lit(seed))).alias("_v"))
    return updated.join(drawn, [*keys, "list_id"], "left").select(*keys, "list_id", F.coalesce("_v", "centroid").alias("centroid"))


def kmeans(points: DataFrame, keys: list[str], k: int, dim: int, max_iter: int, init: DataFrame | None = None, seed: int = 0, refill: bool = True) -> tuple[DataFrame, DataFrame]:
    """(centroids(keys, list_id, centroid), points with list_id) after at most max_iter rounds and a last assignment.

    A round assigns, stops if no assignment changed (before the first all count as 0, so one list is never updated), else moves the centroids. With refill, a list
    left empty is drawn anew; without, it keeps its centroid. init sets the start. A round's centroids are a small table, written so that no plan grows.
    """
    centroids = stash(init if init is not None else seeded_rows(points, keys, k, seed), "centroids")
    before: DataFrame | None = None
    for i in range(max_iter):
        now = assign(points, centroids, keys, dim)
        same = now.filter("list_id <> 0").isEmpty() if before is None else now.join(before, [*keys, "pos"]).filter("list_id <> _old").isEmpty()
        if same:
            break
        moved = update(now, centroids, keys, dim)
        centroids = stash(reseed(now, moved, keys, seed + i) if refill else moved, "centroids")
        before = now.select(*keys, "pos", F.col("list_id").alias("_old")) if i + 1 < max_iter else None
        before = stash(before, "assigned") if before is not None else None
    return centroids, assign(points, centroids, keys, dim)


def every_list(keys: DataFrame, lists: int) -> DataFrame:
    """A row for each group and list number."""
    return keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(lists - 1))).alias("list_id"))


def list_sizes(assigned: DataFrame, lists: int) -> DataFrame:
    """(stream_id, list_id, n), lists without rows included."""
    n = assigned.groupBy("stream_id", "list_id").agg(F.count("*").alias("n"))
    return every_list(assigned.select("stream_id").distinct(), lists).join(n, ["stream_id", "list_id"], "left").select("stream_id", "list_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def inverted(assigned: DataFrame, lists: int) -> DataFrame:
    """(stream_id, list_id, n, first, members): each list's positions in order and where it begins if lists are laid end to end.

    The running sum is over rows a list, not rows a position.
    """
    members = assigned.groupBy("stream_id", "list_id").agg(F.sort_array(F.collect_list("pos")).alias("members"))
    sizes = list_sizes(assigned, lists)
    w = Window.partitionBy("stream_id").orderBy("list_id").rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0))).join(members, ["stream_id", "list_id"], "left")
    return out.withColumn("members", F.coalesce("members", F.array().cast("array<bigint>")))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Inverted lists of rows that were there and of rows added, as one such table: only lists are joined and sorted, no assignment is read again."""
    both = old.select("stream_id", "list_id", "n", "members").unionByName(new.select("stream_id", "list_id", "n", "members"))
    lists = both.groupBy("stream_id", "list_id").agg(F.sum("n").alias("n"), F.sort_array(F.flatten(F.collect_list("members"))).alias("members"))
    w = Window.partitionBy("stream_id").orderBy("list_id").rowsBetween(Window.unboundedPreceding, -1)
    return lists.withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0)))


def health(assigned: DataFrame, lists: int) -> DataFrame:
    """(stream_id, lists, empty, largest, rows)."""
    sizes = list_sizes(assigned, lists)
    return sizes.groupBy("stream_id").agg(F.count("*").alias("lists"), F.count_if(F.col("n") == 0).alias("empty"), F.max("n").alias("largest"), F.sum("n").alias("rows"))


def value_means(assigned: DataFrame, dim: int) -> DataFrame:
    """(stream_id, list_id, n, v_sum, v_mean) of the column `value`; a list without rows isn't there and counts as a mean of zero."""
    from vexil.functions.vectors import sum_by_dim

    out = assigned.groupBy("stream_id", "list_id").agg(F.count("*").alias("n"), sum_by_dim(F.col("value"), dim).alias("v_sum"))
    return out.withColumn("v_mean", F.transform("v_sum", lambda x: x / F.col("n")))


def merge_value_means(old: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """Two such tables of disjoint rows as one."""
    from vexil.functions.vectors import sum_by_dim

    both = old.select("stream_id", "list_id", "n", "v_sum").unionByName(new.select("stream_id", "list_id", "n", "v_sum"))
    out = both.groupBy("stream_id", "list_id").agg(F.sum("n").alias("n"), sum_by_dim(F.col("v_sum"), dim).alias("v_sum"))
    return out.withColumn("v_mean", F.transform("v_sum", lambda x: x / F.col("n")))
