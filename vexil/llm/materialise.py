"""Training-order materialisation: token ids cut into sequences, each put at a global slot by a keyed permutation, slots written as fixed-stride shards.

A document has no more tokens than bytes, so its bytes alone tell how many places to reserve for its sequences: a scan that sums them a partition lets the next scan number
its sequences without a shuffle, and texts are tokenised once. A balanced Feistel network on the numbers below the next power of four, walked along its cycles
until the number is one of the reserved, permutes the places without a table. Sequences then go once through a shuffle to the task that holds their range of
places, which writes its shards in that order, every record of the same size. A sequence's slot is its place counted over those in use, so slots are dense: a
manifest with one row a shard has the first slot of each, and a reader finds a slot by it, reads sequentially from there, and resumes from a slot number alone.
"""

from __future__ import annotations

import base64
import functools
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.llm.common import fresh_path, maybe_broadcast, mix64, small_batches, stash

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenizer of that vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
#: Ids a sequence; places a shard (about half of them are in use).
LENGTH, SPAN, ROUNDS, KEY = 512, 8192, 6, 20240517


class Permutation:
    """A keyed permutation of range(n)."""

    def __init__(self, n: int, key: int = KEY, rounds: int = ROUNDS) -> None:
        self.n = n
        self.half = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def _once(self, x: np.ndarray, keys: np.ndarray, back: bool = False) -> np.ndarray:
        a, b = x >> self.half, x & self.mask
        for k in keys:
            if back:
                a, b = b ^ (mix64(a + k) & self.mask), a
            else:
                a, b = b, a ^ (mix64(b + k) & self.mask)
        return (a << self.half) | b

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        keys = self.keys[::-1] if back else self.keys
        out = self._once(np.asarray(x, np.uint64), keys, back)
        while (over := out >= np.uint64(self.n)).any():
            out[over] = self._once(out[over], keys, back)
        return out.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, False)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


class Tokens:
    """Token ids of a byte-level vocabulary."""

    def __init__(self, path: str = RANKS) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """With the end id behind them."""
        return np.frombuffer(self.encode(text), "<u2")

    def encode(self, text: str) -> bytes:
        """As little-endian 16-bit numbers, the end id behind them."""
        ids = array("H", self.encoding.encode_ordinary(text))
        ids.append(END)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


@functools.lru_cache(2)
def tokens(path: str) -> Tokens:
    """One a worker process."""
    return Tokens(path)


def sequences(docs: DataFrame, path: str = RANKS, length: int = LENGTH, key: int = KEY) -> tuple[DataFrame, int]:
    """((place, doc_id, part, n_tokens, payload), number of places) for docs(doc_id, text), which must be a scan that gives the same rows in the same order again.

    A document is its ids and one end id, cut every `length` ids; a null text is the end id alone. The sum a partition is one row to the driver and one number sent
    back, so it is bounded by the number of file splits. If the second scan reserves another number, it fails instead of giving two sequences one place.
    """
    small_batches(docs.sparkSession)
    room = F.ceil((F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / length).cast("long")
    sums = {r["pid"]: r["n"] for r in docs.select(F.spark_partition_id().alias("pid"), room.alias("room")).groupBy("pid").agg(F.sum("room").alias("n")).collect()}
    total = sum(sums.values())
    starts, at = {}, 0
    for pid in sorted(sums):
        starts[pid] = at
        at += sums[pid]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = tokens(path)
        pid = TaskContext.get().partitionId()
        at, order = starts.get(pid, 0), Permutation(max(1, total), key)
        for pdf in batches:
            rows, index = [], []
            for doc, text, room in zip(pdf["doc_id"], pdf["text"], pdf["room"].tolist(), strict=True):
                ids = vocabulary.encode(text or "")
                cuts = range(0, len(ids), 2 * length)
                rows += [(doc, i, len(p) // 2, p) for i, p in enumerate(ids[j : j + 2 * length] for j in cuts)]
                index += range(at, at + len(cuts))
                at += room
            out = pd.DataFrame(rows, columns=["doc_id", "part", "n_tokens", "payload"])
            out.insert(0, "place", order.slot(np.array(index, np.int64)))
            yield out
        if at != starts.get(pid, 0) + sums.get(pid, 0):
            raise RuntimeError("the table changed between two scans")

    rows = docs.select(F.col("doc_id").cast("long"), "text", room.alias("room"))
    return rows.mapInPandas(run, "place long, doc_id long, part int, n_tokens int, payload binary"), total


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _folder(where: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(where if "://" in where or where.startswith("file:") else f"file://{where}")


def materialise(docs: DataFrame, where: str | None = None, path: str = RANKS, length: int = LENGTH, span: int = SPAN, key: int = KEY) -> DataFrame:
    """Writes shards and, when all are there, the manifest below `where` (a new folder in the shared folder by default).

    Result: (slot, shard, byte_offset, doc_id, part, n_tokens, crc) a sequence; crc is of the stored bytes. A shard is written under another name and moved, so a
    task that runs again, or a job that is resumed, leaves whole shards only, with equal bytes. Ids beyond a short last part are END. An empty table writes
    nothing. Repeated and null doc_ids are sequences like others.
    """
    spark = docs.sparkSession
    where = where or fresh_path(spark, "shards")
    rows, total = sequences(docs, path, length, key)
    shards = max(1, -(-total // span))
    tasks = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards // 64)))
    stride = 2 * length
    pad = np.array(END, "<u2").tobytes()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _folder(where)
        fs.create_dir(base, recursive=True)
        now, held = None, []

        def close() -> None:
            if now is not None:
                name = f"{base}/{shard_name(now)}"
                own = f"{name}.{TaskContext.get().taskAttemptId()}"
                with fs.open_output_stream(own) as out:
                    out.write(b"".join(held))
                fs.move(own, name)

        for pdf in batches:
            crc, rank = [], []
            for place, payload in zip(pdf["place"].tolist(), pdf["payload"], strict=True):
                if place // span != now:
                    close()
                    now, held = place // span, []
                rank.append(len(held))
                held.append(payload + pad * ((stride - len(payload)) // 2))
                crc.append(zlib.crc32(held[-1]))
            yield pd.DataFrame({"shard": pdf["place"] // span, "rank": rank, "doc_id": pdf["doc_id"], "part": pdf["part"], "n_tokens": pdf["n_tokens"], "crc": crc})
        close()

    home = (F.floor(F.col("place") / span) * tasks / shards).cast("int")
    dealt = rows.repartitionById(tasks, home).sortWithinPartitions("place")
    written = stash(dealt.mapInPandas(write, "shard long, rank long, doc_id long, part int, n_tokens int, crc long"), "sequences")
    counts = written.groupBy("shard").agg(F.count("*").alias("n")).toPandas().sort_values("shard")
    counts["first"] = counts["n"].cumsum() - counts["n"]
    manifest = spark.createDataFrame(counts.astype("int64"), "shard long, n long, first long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{where}/manifest")
    out = written.join(maybe_broadcast(manifest, len(counts), 32), "shard")
    slot, offset = F.col("first") + F.col("rank"), F.col("rank") * stride
    return out.select(slot.alias("slot"), "shard", offset.alias("byte_offset"), "doc_id", "part", "n_tokens", "crc")


def read_slots(where: str, first: int, last: int, length: int = LENGTH) -> Iterator[np.ndarray]:
    """Token ids of slots first to last - 1, in order: one look into the manifest, then sequential reads."""
    fs, base = _folder(where)
    table = pyarrow.parquet.read_table(f"{base}/manifest", filesystem=fs).to_pandas().sort_values("first")
    shards, firsts, counts = (table[c].to_numpy() for c in ("shard", "first", "n"))
    stride, i = 2 * length, int(np.searchsorted(firsts, first, "right")) - 1
    while first < last:
        at = first - int(firsts[i])
        n = min(last - first, int(counts[i]) - at)
        with fs.open_input_file(f"{base}/{shard_name(int(shards[i]))}") as f:
            f.seek(at * stride)
            data = f.read(n * stride)
        yield from np.frombuffer(data, "<u2").reshape(-1, length)
        first += n
        i += 1
