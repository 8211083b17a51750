"""The sequence that the registered queries run on: `embeddings` as keys, their first eight components as values, vec_id as position, every
row whose position is divisible by 100 as a query."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexil.functions import vectors as V
from vexil.operators import attention as A
from vexil.operators import ivf
from vexil.operators import kmeans as K
from vexil.operators.config import AttentionConfig, IndexConfig
from vexil.sources.shared import stash

DIM, DIM_VALUE, SCALE = 64, 8, 0.125
SINK, LOCAL, LISTS, PIECES = 4, 128, 8, 8
INDEX = IndexConfig(num_lists=LISTS, nprobe=2, num_subspaces=PIECES, num_bits=4, coarse_max_iter=1, pq_max_iter=1)
HYBRID = AttentionConfig(sink=SINK, local=LOCAL, top_fraction=0.01, nprobe=2, mode="hybrid", value_mode="centroid")


class Canon:
    """Tables of one run; the index is built once and its small tables are written."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def kv(self) -> DataFrame:
        e = V.doubles(F.col("embedding"))
        return self.table("embeddings").select(F.lit(0).cast("long").alias("stream_id"), F.col("vec_id").alias("pos"), e.alias("key"), F.slice(e, 1, DIM_VALUE).alias("value"), "label")

    @cached_property
    def queries(self) -> DataFrame:
        return self.kv.filter("pos % 100 = 0").select(F.col("pos").alias("query_id"), "stream_id", F.col("key").alias("q"))

    @cached_property
    def regions(self) -> DataFrame:
        return A.regions(self.kv, SINK, LOCAL)

    @cached_property
    def retrieval(self) -> DataFrame:
        return self.regions.filter("region = 'retrieval'")

    @cached_property
    def points(self) -> DataFrame:
        return ivf.projected(self.retrieval, INDEX, DIM, None)

    def first(self, n: int) -> DataFrame:
        """The first n retrieval rows as centroids: positions are known, so no row is ranked."""
        return self.points.filter((F.col("pos") >= SINK) & (F.col("pos") < SINK + n)).select("stream_id", (F.col("pos") - SINK).cast("int").alias("list_id"), F.col("v").alias("centroid"))

    @cached_property
    def coarse_and_assigned(self) -> tuple[DataFrame, DataFrame]:
        coarse, assigned = K.kmeans(self.points, ["stream_id"], LISTS, DIM, INDEX.coarse_max_iter, self.first(LISTS), refill=False)
        return coarse, stash(assigned, "assigned")

    @property
    def assigned(self) -> DataFrame:
        return self.coarse_and_assigned[1]

    @cached_property
    def residual(self) -> DataFrame:
        return ivf.residuals(self.assigned, self.coarse_and_assigned[0], INDEX)

    @cached_property
    def codebook(self) -> DataFrame:
        first = ivf.subvectors(self.residual.filter((F.col("pos") >= SINK) & (F.col("pos") < SINK + INDEX.words)), INDEX, DIM)
        init = first.select("stream_id", "m", (F.col("pos") - SINK).cast("int").alias("list_id"), F.col("v").alias("centroid"))
        return ivf.train_pq(self.residual, INDEX, DIM, init, refill=False)

    @cached_property
    def index(self) -> ivf.Index:
        coarse, _ = self.coarse_and_assigned
        codes = ivf.encode(self.residual, self.codebook, INDEX, DIM).select("stream_id", "pos", "list_id", "codes", "key_norm")
        return ivf.Index(INDEX, DIM, coarse, self.codebook, stash(codes, "codes"))

    @cached_property
    def means(self) -> DataFrame:
        return stash(K.value_means(self.assigned, DIM_VALUE), "means")

    def logits(self, cfg: AttentionConfig = HYBRID) -> DataFrame:
        return A.hybrid_logits(self.queries, self.regions, self.index, cfg, DIM)
