"""Keys and values in pages: a block table gives the order of physical blocks; rows come out as a sequence, a range, or scattered positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.sources.shared import small


def gather(table: DataFrame, blocks: DataFrame, block_size: int, start: int = 0, end: int | None = None) -> DataFrame:
    """(seq_id, pos, key, value) of positions from start to end - 1, for table(seq_id, logical_block, physical_block) and blocks(physical_block, slot, key, value).

    Whole blocks outside the range are dropped from the table before it is joined.
    """
    table = table.filter(F.col("logical_block") >= start // block_size)
    table = table.filter(F.col("logical_block") <= (end - 1) // block_size) if end is not None else table
    rows = blocks.join(small(table, 32), "physical_block").withColumn("pos", F.col("logical_block") * block_size + F.col("slot"))
    inside = (F.col("pos") >= start) & (F.col("pos") < end if end is not None else F.lit(True))
    return rows.filter(inside).select("seq_id", "pos", "key", "value")


def gather_at(table: DataFrame, blocks: DataFrame, block_size: int, wanted: DataFrame) -> DataFrame:
    """The same for wanted(seq_id, pos): each wanted row finds its block, then its slot."""
    at = wanted.withColumn("logical_block", F.floor(F.col("pos") / block_size).cast("long")).withColumn("slot", F.pmod("pos", F.lit(block_size)))
    found = at.join(table, ["seq_id", "logical_block"]).select("seq_id", "pos", "physical_block", "slot")
    return found.join(blocks, ["physical_block", "slot"]).select("seq_id", "pos", "key", "value")


def interleaved(blocks: DataFrame, dim: int) -> DataFrame:
    """Blocks whose rows hold key and value as one vector, in the two-column layout."""
    return blocks.select("physical_block", "slot", F.slice("kv", 1, dim).alias("key"), F.slice("kv", dim + 1, dim).alias("value"))


def rows_at(kv: DataFrame, wanted: DataFrame, keys: bool = True, values: bool = True) -> DataFrame:
    """kv at wanted(stream_id, pos); a column that isn't asked for isn't read."""
    cols = ["stream_id", "pos", *(["key"] if keys else []), *(["value"] if values else [])]
    return kv.select(*cols).join(small(wanted.select("stream_id", "pos"), 32), ["stream_id", "pos"])


def global_positions(rows: DataFrame, sink: int, length: int) -> DataFrame:
    """Positions of the retrieval region as positions of the whole sequence."""
    return rows.withColumn("pos", F.col("pos") + min(sink, length))
