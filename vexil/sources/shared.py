"""Tables cut from their lineage: Parquet in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcasts are only made of tables whose counted rows times row width stay below this.
BROADCAST_BYTES = 32 << 20
_LOCAL: list[str] = []
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and the master is local."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="vexil-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        where = _LOCAL[0]
    return where.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/vexil-{what}-{uuid.uuid4().hex}"


def stash(df: DataFrame, what: str, codec: str = "snappy") -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here and a lost executor loses nothing.

    snappy pages hold their own length. lz4_raw ones don't, and a filter on a column whose dictionary exceeds 8 KB fails on them ("all input must be consumed"):
    Parquet reads that dictionary in pieces and takes a piece's length for the page's. zstd takes more memory outside the heap, which Python workers need.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("compression", codec).parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables stash() has written so far."""
    return len(_MADE)


def drop_since(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Removes the tables that stash() wrote since the mark, but for the last `keep`: for a caller who has written what was made of them."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    gone = _MADE[since : len(_MADE) - keep]
    for path in gone:
        hadoop(path).getFileSystem(conf).delete(hadoop(path), True)
    del _MADE[since : len(_MADE) - keep]


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the counted rows are proved to fit; else df as it is, for a shuffled join that AQE can split."""
    return F.broadcast(df) if rows * row_bytes <= most else df


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """maybe_broadcast() of a table that is cheap to count."""
    return maybe_broadcast(df, df.count(), row_bytes)


#: Parts that the rows of one stream are dealt in, where what they meet is too large to broadcast.
PARTS = 64


def meet(rows: DataFrame, side: DataFrame, row_bytes: int, by: str = "pos") -> DataFrame:
    """rows joined with side on stream_id. A side whose counted rows fit is broadcast; a larger one goes to each of PARTS parts of the rows, dealt by `by`, so that
    one stream isn't one task."""
    n = side.count()
    if n * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(side), "stream_id")
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(PARTS)))
    return dealt.join(side.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))), ["stream_id", "_part"]).drop("_part")
