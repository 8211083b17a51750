"""The inverted-file index with product-quantized residuals: four tables and a configuration.

coarse(stream_id, list_id, centroid) · codebook(stream_id, m, list_id, centroid), list_id being the code · codes(stream_id, pos, list_id, codes, key_norm) · rotation.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexil.functions import vectors as V
from vexil.operators import kmeans as K
from vexil.operators.config import IndexConfig
from vexil.sources.shared import small, stash

@dataclass(frozen=True)
class Index:
    config: IndexConfig
    dim: int
    coarse: DataFrame
    codebook: DataFrame
    codes: DataFrame
    rotation: np.ndarray | None = None

    @property
    def sub(self) -> int:
        return self.dim // self.config.num_subspaces


def projected(rows: DataFrame, cfg: IndexConfig, dim: int, turn: np.ndarray | None) -> DataFrame:
    """rows(stream_id, pos, key, ...) with v, the rotated (and, if configured, unit) key, and key_norm (1 without direction_normalize)."""
    v = V.doubles(F.col("key"))
    v = V.rotate(v, turn) if turn is not None else v
    out = rows.withColumn("v", v)
    if not cfg.direction_normalize:
        return out.withColumn("key_norm", F.lit(1.0))
    return out.withColumn("key_norm", V.norm(F.col("v"), dim, cfg.eps)).withColumn("v", F.transform("v", lambda x: x / F.col("key_norm")))


def residuals(assigned: DataFrame, coarse: DataFrame, cfg: IndexConfig) -> DataFrame:
    """assigned(stream_id, list_id, v, ...) with r: v less its list's centroid, or v itself without residual coding."""
    if not cfg.residual:
        return assigned.withColumn("r", F.col("v"))
    held = small(coarse.select("stream_id", "list_id", F.col("centroid").alias("_c")), 1024)
    return assigned.join(held, ["stream_id", "list_id"]).withColumn("r", V.minus(F.col("v"), F.col("_c"))).drop("_c")


def subvectors(rows: DataFrame, cfg: IndexConfig, dim: int) -> DataFrame:
    """(stream_id, pos, m, v): the pieces of r, a row a piece."""
    size = dim // cfg.num_subspaces
    pieces = F.array(*(V.piece(F.col("r"), m, size) for m in range(cfg.num_subspaces)))
    return rows.select("stream_id", "pos", F.posexplode(pieces).alias("m", "v"))


def train_pq(rows: DataFrame, cfg: IndexConfig, dim: int, init: DataFrame | None = None, refill: bool = True) -> DataFrame:
    """A codebook for each stream and piece: independent k-means on the pieces of r, all at once by (stream_id, m)."""
    keys = ["stream_id", "m"]
    return K.kmeans(subvectors(rows, cfg, dim), keys, cfg.words, dim // cfg.num_subspaces, cfg.pq_max_iter, init, cfg.seed + 10000, refill)[0]


def encode(rows: DataFrame, codebook: DataFrame, cfg: IndexConfig, dim: int) -> DataFrame:
    """rows(stream_id, r, ...) with codes: for each piece the nearest word, ties to the smaller code. No row is multiplied or shuffled."""
    size = dim // cfg.num_subspaces
    word = F.struct("list_id", F.col("centroid").alias("c"), V.dot(F.col("centroid"), F.col("centroid"), size).alias("cc"))
    books = codebook.groupBy("stream_id", "m").agg(F.sort_array(F.collect_list(word)).alias("ws"))
    books = books.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("m", "ws"))).alias("_books"))

    def code(m: int) -> Column:
        v = V.piece(F.col("r"), m, size)
        ws = F.get("_books", F.lit(m))["ws"]
        return F.array_min(F.transform(ws, lambda w: F.struct((w["cc"] - 2 * V.dot(v, w["c"], size)).alias("d"), w["list_id"].alias("l"))))["l"]

    held = small(books, cfg.num_subspaces * cfg.words * (16 * size + 32))
    return rows.join(held, "stream_id").withColumn("codes", F.array(*(code(m) for m in range(cfg.num_subspaces)))).drop("_books")


def coded(rows: DataFrame, coarse: DataFrame, codebook: DataFrame, cfg: IndexConfig, dim: int, turn: np.ndarray | None) -> DataFrame:
    """Codes of rows(stream_id, pos, key) under given centroids and codebooks: one scan, no loop."""
    assigned = K.assign(projected(rows, cfg, dim, turn), coarse, ["stream_id"], dim)
    out = encode(residuals(assigned, coarse, cfg), codebook, cfg, dim)
    return out.select("stream_id", "pos", "list_id", "codes", "key_norm")


def build(rows: DataFrame, cfg: IndexConfig, dim: int, coarse_init: DataFrame | None = None, pq_init: DataFrame | None = None, refill: bool = True) -> Index:
    """An index of rows(stream_id, pos, key). Starting centroids and words may be given; else they are drawn by a hash of the seed."""
    cfg.check(dim, 1)
    turn = V.rotation(dim, cfg.seed) if cfg.rotation == "random_orthogonal" else None
    points = projected(rows.select("stream_id", "pos", "key"), cfg, dim, turn)
    coarse, assigned = K.kmeans(points, ["stream_id"], cfg.num_lists, dim, cfg.coarse_max_iter, coarse_init, cfg.seed, refill)
    rest = residuals(assigned, coarse, cfg)
    codebook = train_pq(rest, cfg, dim, pq_init, refill)
    codes = encode(rest, codebook, cfg, dim).select("stream_id", "pos", "list_id", "codes", "key_norm")
    return Index(cfg, dim, coarse, codebook, stash(codes, "codes"), turn)


def build_with_codebooks(rows: DataFrame, cfg: IndexConfig, dim: int, coarse: DataFrame, codebook: DataFrame, turn: np.ndarray | None = None) -> Index:
    """An index whose centroids and codebooks are given, for each stream or, with stream_id left out, for all streams."""
    if "stream_id" not in coarse.columns:
        streams = rows.select("stream_id").distinct()
        coarse, codebook = (streams.withColumn("_all", F.lit(1)).join(t.withColumn("_all", F.lit(1)), "_all").drop("_all") for t in (coarse, codebook))
    return Index(cfg, dim, coarse, codebook, stash(coded(rows, coarse, codebook, cfg, dim, turn), "codes"), turn)


def shared_layer(rows: DataFrame, cfg: IndexConfig, dim: int) -> Index:
    """One codebook trained on the keys of all streams, then codes for each stream."""
    one = rows.withColumn("pos", F.xxhash64("stream_id", "pos")).withColumn("stream_id", F.lit(0).cast("long"))
    trained = build(one, cfg, dim)
    return build_with_codebooks(rows, cfg, dim, trained.coarse.drop("stream_id"), trained.codebook.drop("stream_id"), trained.rotation)


def reconstruct(index: Index, codes: DataFrame | None = None) -> DataFrame:
    """(stream_id, pos, key): the words of a row's codes, plus its centroid, times its norm, turned back."""
    cfg, codes = index.config, index.codes if codes is None else codes
    words = index.codebook.groupBy("stream_id", "m").agg(F.map_from_entries(F.collect_list(F.struct("list_id", "centroid"))).alias("ws"))
    words = words.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("m", F.map_entries("ws").alias("ws")))).alias("_b"))
    parts = [F.element_at(F.map_from_entries(F.get("_b", F.lit(m))["ws"]), F.get("codes", F.lit(m))) for m in range(cfg.num_subspaces)]
    out = codes.join(small(words, cfg.num_subspaces * cfg.words * (16 * index.sub + 32)), "stream_id").withColumn("v", F.concat(*parts))
    if cfg.residual:
        out = out.join(small(index.coarse.select("stream_id", "list_id", F.col("centroid").alias("_c")), 1024), ["stream_id", "list_id"]).withColumn("v", V.plus(F.col("v"), F.col("_c")))
    v = F.transform("v", lambda x: x * F.col("key_norm"))
    return out.select("stream_id", "pos", (V.rotate(v, index.rotation.T) if index.rotation is not None else v).alias("key"))


def packed(index: Index) -> DataFrame:
    """(stream_id, pos, list_id, packed, key_norm), written: two 4-bit codes a number, as search.packed_scan() reads them."""
    if not index.config.packed:
        raise ValueError("codes are packed only if configured, with 4 bits")
    return stash(index.codes.select("stream_id", "pos", "list_id", V.pack4(F.col("codes"), index.config.num_subspaces).alias("packed"), "key_norm"), "packed")


def footprint(index: Index, codes: DataFrame | None = None, bytes_a_number: int = 2) -> DataFrame:
    """(stream_id, rows, code_bytes, list_bytes, norm_bytes, codebook_bytes, total_bytes, key_compression_ratio) of a stored table of codes, index.codes or that of packed():
    a byte an entry of its codes. A ratio of 1 when nothing is indexed."""
    cfg, codes = index.config, index.codes if codes is None else codes
    entries = F.size("packed" if "packed" in codes.columns else "codes")
    list_width = 2 if cfg.num_lists <= 1 << 16 else 4
    fixed = bytes_a_number * (cfg.num_lists * index.dim + cfg.num_subspaces * cfg.words * index.sub)
    out = codes.groupBy("stream_id").agg(F.count("*").alias("rows"), F.sum(entries).cast("long").alias("code_bytes")).withColumn("list_bytes", F.col("rows") * list_width)
    out = out.withColumn("norm_bytes", F.col("rows") * (bytes_a_number if cfg.direction_normalize else 0)).withColumn("codebook_bytes", F.lit(fixed).cast("long"))
    total = F.col("code_bytes") + F.col("list_bytes") + F.col("norm_bytes") + F.col("codebook_bytes")
    ratio = F.when(F.col("rows") > 0, F.col("rows") * index.dim * bytes_a_number / total).otherwise(1.0)
    return out.withColumn("total_bytes", total).withColumn("key_compression_ratio", ratio)


# maintenance


def add(index: Index, rows: DataFrame) -> Index:
    """Rows appended under frozen centroids and codebooks."""
    new = coded(rows, index.coarse, index.codebook, index.config, index.dim, index.rotation)
    return replace(index, codes=index.codes.unionByName(new))


def blended(old: DataFrame, assigned: DataFrame, keys: list[str], dim: int, rate: float) -> DataFrame:
    """Centroids moved by `rate` to the mean of the batch's rows in their list; a list without such rows stays."""
    mean = assigned.groupBy(*keys, "list_id").agg(V.mean_by_dim(F.col("v"), dim).alias("_m"))
    moved = F.zip_with("centroid", "_m", lambda a, b: a * (1 - rate) + b * rate)
    return old.join(mean, [*keys, "list_id"], "left").select(*keys, "list_id", F.coalesce(moved, "centroid").alias("centroid"))


def moved(index: Index, batch: DataFrame, rate: float | None = None) -> Index:
    """Centroids and words moved towards the batch; codes stay."""
    cfg, dim = index.config, index.dim
    rate = cfg.online_codebook_lr if rate is None else rate
    if not 0 < rate <= 1:
        raise ValueError("a learning rate must be in (0, 1]")
    points = projected(batch, cfg, dim, index.rotation)
    coarse = stash(blended(index.coarse, K.assign(points, index.coarse, ["stream_id"], dim), ["stream_id"], dim, rate), "centroids")
    rest = residuals(K.assign(points, coarse, ["stream_id"], dim), coarse, cfg)
    pieces = K.assign(subvectors(rest, cfg, dim), index.codebook, ["stream_id", "m"], index.sub)
    return replace(index, coarse=coarse, codebook=stash(blended(index.codebook, pieces, ["stream_id", "m"], index.sub, rate), "words"))


def online_refresh(index: Index, rows: DataFrame, batch: DataFrame, rate: float | None = None) -> Index:
    """Centroids and words moved towards the batch, then all rows coded anew (reencode = all)."""
    out = moved(index, batch, rate)
    return replace(out, codes=stash(coded(rows, out.coarse, out.codebook, out.config, out.dim, out.rotation), "codes"))


def delta_flush(index: Index, batch: DataFrame, rate: float | None = None) -> Index:
    """Centroids and words moved towards the batch, and only the batch coded under them; older codes stay as they are (reencode = delta)."""
    out = moved(index, batch, rate)
    return replace(out, codes=index.codes.unionByName(coded(batch, out.coarse, out.codebook, out.config, out.dim, out.rotation)))


def rebuild(index: Index, rows: DataFrame, warm: bool = True) -> Index:
    """A new build, starting from the present centroids if warm (cut or filled up to the number of lists)."""
    init = None
    if warm:
        kept = index.coarse.filter(F.col("list_id") < index.config.num_lists)
        points = projected(rows, index.config, index.dim, index.rotation)
        drawn = K.seeded_rows(points, ["stream_id"], index.config.num_lists, index.config.seed)
        init = kept.unionByName(drawn.join(kept, ["stream_id", "list_id"], "left_anti"))
    return build(rows, index.config, index.dim, init)
