"""Appending rows to an indexed sequence: counters, refresh strategies, prefix checkpoints, speculative steps, and a micro-batch adapter.

A Stream is the state of one request: all its heads (stream_ids) grow in step, one row a head at each position. Rows and codes are tables; the state object has
numbers only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexil.operators import attention as A
from vexil.operators import ivf
from vexil.operators import kmeans as K
from vexil.operators.config import AttentionConfig, IndexConfig
from vexil.sources.shared import small, stash


#: Written parts of a stream's rows before they become one.
PARTS = 16


@dataclass
class Counters:
    rebuilds: int = 0
    adds: int = 0
    online_updates: int = 0
    refreshes: int = 0
    deferred: int = 0


@dataclass
class Stream:
    """rows(stream_id, pos, key, value); positions below indexed_length are indexed once they are neither sink nor local."""

    config: IndexConfig
    attention: AttentionConfig
    dim: int
    rows: DataFrame
    length: int
    index: ivf.Index | None = None
    indexed_length: int = 0
    pending: int = 0
    waiting: bool = False
    since_refresh: int = 0
    parts: int = 1
    counters: Counters = field(default_factory=Counters)

    @property
    def sink_end(self) -> int:
        return min(self.attention.sink, self.length)

    def retrieval_end(self, upto: int) -> int:
        return max(self.sink_end, upto - self.attention.local)

    def between(self, first: int, last: int) -> DataFrame:
        return self.rows.filter((F.col("pos") >= first) & (F.col("pos") < last))

    @staticmethod
    def build(rows: DataFrame, config: IndexConfig, attention: AttentionConfig, dim: int, **init: DataFrame) -> Stream:
        rows = stash(rows.select("stream_id", "pos", "key", "value"), "rows")
        length = (rows.agg(F.max("pos")).first()[0] or -1) + 1 if not rows.isEmpty() else 0
        out = Stream(config, attention, dim, rows, length, indexed_length=length)
        out._build(**init)
        return out

    def _build(self, **init: DataFrame) -> None:
        region = self.between(self.sink_end, self.retrieval_end(self.indexed_length))
        self.index = None if region.isEmpty() else ivf.build(region, self.config, self.dim, **init)

    def append(self, new: DataFrame, count: int = 1) -> None:
        """new(stream_id, pos, key, value) at positions length to length + count - 1: local at once, indexed when update_interval rows are pending."""
        self._add(new)
        self.length += count
        self.pending += count
        if self.pending >= self.attention.update_interval:
            if self.attention.strategy == "deferred":
                self.counters.deferred += not self.waiting
                self.waiting = True
            else:
                self._refresh()

    def _add(self, new: DataFrame) -> None:
        """Writes the new rows only; every PARTS appends the parts are written as one, so a row is written again once in PARTS appends and plans stay short."""
        self.rows = self.rows.unionByName(stash(new.select("stream_id", "pos", "key", "value"), "rows"))
        self.parts += 1
        if self.parts >= PARTS:
            self.rows, self.parts = stash(self.rows, "rows"), 1
            self.index = self.index and replace(self.index, codes=stash(self.index.codes, "codes"))

    def _coded(self, index: ivf.Index, new: DataFrame) -> ivf.Index:
        """index with the new codes written beside the old ones, which stay where they are."""
        return replace(index, codes=self.index.codes.unionByName(stash(new, "codes")))

    def apply_pending(self) -> bool:
        """Does what was deferred; whether there was any."""
        if not self.waiting:
            return False
        self._refresh()
        return True

    def _refresh(self) -> None:
        first, last = self.retrieval_end(self.indexed_length), self.retrieval_end(self.length)
        every = self.attention.codebook_refresh_interval
        self.indexed_length, self.pending, self.waiting = self.length, 0, False
        self.counters.refreshes += 1
        self.since_refresh += max(0, last - first)
        if self.index is None or self.attention.strategy == "rebuild" or (every and self.since_refresh >= every):
            self._rebuild()
        elif last > first:
            new = self.between(first, last)
            if self.attention.strategy == "online":
                self.index = ivf.online_refresh(self.index, self.between(self.sink_end, last), new)
                self.counters.online_updates += 1
            elif self.attention.strategy == "deferred":
                moved = ivf.moved(self.index, new)
                self.index = self._coded(moved, ivf.coded(new, moved.coarse, moved.codebook, moved.config, moved.dim, moved.rotation))
                self.counters.online_updates += 1
            else:
                at = self.index
                self.index = self._coded(at, ivf.coded(new, at.coarse, at.codebook, at.config, at.dim, at.rotation))
                self.counters.adds += 1

    def _rebuild(self) -> None:
        region = self.between(self.sink_end, self.retrieval_end(self.indexed_length))
        if self.index is not None:
            self.index = ivf.rebuild(self.index, region)
        else:
            self._build()
        self.counters.rebuilds += 1
        self.since_refresh = 0

    def kv(self) -> DataFrame:
        """Rows with regions: what isn't indexed yet is local."""
        end = self.retrieval_end(self.indexed_length)
        region = F.when(F.col("pos") < self.sink_end, "sink").when(F.col("pos") >= end, "local").otherwise("retrieval")
        return self.rows.filter(F.col("pos") < self.length).withColumn("region", region)

    def forward(self, queries: DataFrame, dim_value: int) -> DataFrame:
        """(query_id, d, value). With nothing indexed, softmax over sink and local rows."""
        kv, cfg = self.kv(), self.attention
        if self.index is None:
            return A.dense(queries, kv, cfg.scaled(self.dim), self.dim, dim_value)
        logits = A.hybrid_logits(queries, kv, self.index, cfg, self.dim)
        means = None
        if cfg.mode == "hybrid" and cfg.value_mode == "centroid":
            means = K.value_means(self.index.codes.join(kv.select("stream_id", "pos", "value"), ["stream_id", "pos"]), dim_value)
        return A.attend(logits, cfg, dim_value, means)

    def decode_step(self, new: DataFrame, queries: DataFrame, dim_value: int) -> DataFrame:
        """Appends, then attends: a query sees its own row."""
        self.append(new)
        return self.forward(queries, dim_value)

    def append_many(self, new: DataFrame, start: int, count: int, flush_every: int) -> int:
        """Rows at positions start to start + count - 1, rewinding to start first; deferred work is done between chunks of flush_every, not after the last. Returns the
        number of flushes."""
        if start > self.length:
            raise ValueError("start lies beyond the rows")
        self.rows = self.rows.filter(F.col("pos") < start)
        self._add(new)
        self.length, flushes = start, 0
        for at in range(0, count, flush_every):
            size = min(flush_every, count - at)
            self.length += size
            self.pending += size
            if self.pending >= self.attention.update_interval and not self.waiting:
                self.counters.deferred += 1
                self.waiting = True
            if at + size < count and self.apply_pending():
                flushes += 1
        return flushes

    def checkpoint(self) -> Stream:
        """A copy by reference: tables don't change, so it costs nothing."""
        return replace(self, counters=replace(self.counters))

    def restore(self, saved: Stream | None) -> bool:
        """Back to a checkpoint; False without one. Rows beyond its length are ignored from then on."""
        if saved is None:
            return False
        for name, x in vars(saved.checkpoint()).items():
            setattr(self, name, x)
        self.rows = self.rows.filter(F.col("pos") < self.length)
        return True

    def extend_prefix(self, saved: Stream | None, new: DataFrame, new_length: int, room: int | None = None) -> bool:
        """Restores a shorter prefix and appends what is longer, from the prefix's last position on (its row was the first decoded one and is written anew); one flush.
        False, so that the caller rebuilds, without a checkpoint, if it isn't longer, or beyond `room`."""
        if saved is None or new_length <= saved.length or (room is not None and new_length > room):
            return False
        self.restore(saved)
        start = max(0, saved.length - 1)
        self.append_many(new, start, new_length - start, new_length)
        self.apply_pending()
        return True

    def accept(self, saved: Stream, drafted: int, new_length: int) -> str:
        """After a speculative step of `drafted` rows from saved.length: `commit` if all stay, `rollback` to what was accepted, or `rebuild` if neither fits."""
        base = saved.length
        if new_length == base + drafted:
            return "commit"
        if not base <= new_length < base + drafted:
            return "rebuild"
        kept = self.between(base, new_length)
        kept = stash(kept, "kept")
        self.restore(saved)
        if new_length > base:
            self.append(kept, new_length - base)
        return "rollback"


def causal(logits: DataFrame, at: Column) -> DataFrame:
    """Of logits(query_id, pos, ...) those that a query at position `at` may see."""
    return logits.filter(F.col("pos") <= at)


def prefix_matches(stored: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, prefix_id, length): for requests(request_id, ids) and stored(prefix_id, length, digest) prefixes, the longest one that a request begins with; ties go to
    the smaller prefix_id. A request is digested once for each length that is stored, and meets prefixes by length and digest."""
    lengths = small(stored.select("length").distinct(), 16)
    asked = requests.join(lengths, F.size("ids") >= F.col("length")).select("request_id", "length", prefix_digest(F.col("ids"), F.col("length")).alias("digest"))
    found = asked.join(stored, ["length", "digest"])
    return found.groupBy("request_id").agg(F.max(F.struct("length", (-F.col("prefix_id")).alias("p"))).alias("b")).select("request_id", (-F.col("b.p")).alias("prefix_id"), "b.length")


def prefix_digest(ids: Column, length: Column) -> Column:
    return F.md5(F.concat_ws(",", F.slice(ids, F.lit(1), length).cast("array<string>")))


def verdicts(steps: DataFrame, states: DataFrame, least: int) -> DataFrame:
    """(step, verdict) for steps(step, request_id, rows) and states(request_id, length): a whole step is refused if a request has no state, has not one row, or is too short,
    in that order; else it is `admitted`."""
    rows = steps.join(states, "request_id", "left").groupBy("step")
    out = rows.agg(F.max(F.col("length").isNull().cast("int")).alias("m"), F.max((F.col("rows") != 1).cast("int")).alias("r"), F.max((F.col("length") < least).cast("int")).alias("s"))
    return out.select("step", F.when(F.col("m") == 1, "missing_id").when(F.col("r") == 1, "not_one_row").when(F.col("s") == 1, "too_short").otherwise("admitted").alias("verdict"))


def live_states(states: DataFrame, live: DataFrame) -> DataFrame:
    """states(request_id, ...) of requests that are still there."""
    return states.join(live.select("request_id").distinct(), "request_id", "left_semi")


def action(known: Column, length: Column, extendable: Column) -> Column:
    """next_action() as a column."""
    return F.when(known.isNull(), "rebuild").when(length == known + 1, "append").when(length <= known, "restore").when(extendable, "extend").otherwise("rebuild")


def digest(ids: list[int]) -> str:
    return hashlib.blake2b(b",".join(str(i).encode() for i in ids), digest_size=16).hexdigest()


def extension_reason(known: int, known_digest: str, ids: list[int], most_new: float) -> str | None:
    """Why a stored prefix can't be extended to ids, or None: not longer, another beginning, or too much that is new."""
    if len(ids) <= known:
        return "not_longer"
    if digest(ids[:known]) != known_digest:
        return "prefix_differs"
    if (len(ids) - known) / len(ids) > most_new:
        return "too_much_new"
    return None


def next_action(known: int | None, length: int, extendable: bool) -> str:
    """append for the next position, restore for a shorter length, extend or rebuild for others."""
    if known is None:
        return "rebuild"
    if length == known + 1:
        return "append"
    if length <= known:
        return "restore"
    return "extend" if extendable else "rebuild"


@dataclass
class Requests:
    """Independent streams by request id."""

    streams: dict[str, Stream] = field(default_factory=dict)

    def step(self, live: list[str], rows: dict[str, int], least: int) -> str | None:
        """Why the whole step is refused, or None: ids missing, not one row a request, or a request too short. States of departed requests go."""
        if not live or any(r not in self.streams for r in live):
            return "missing_id"
        if any(rows.get(r) != 1 for r in live):
            return "not_one_row"
        if any(self.streams[r].length < least for r in live):
            return "too_short"
        self.streams = {r: self.streams[r] for r in live}
        return None


def each_batch(stream: Stream) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: appends a micro-batch of (stream_id, pos, key, value). A batch that comes again after a failure adds nothing: its positions are
    there already."""

    def run(batch: DataFrame, _: int) -> None:
        new = stash(batch.filter(F.col("pos") >= stream.length), "batch")
        last = new.agg(F.max("pos")).first()[0]
        if last is not None:
            stream.append(new, last + 1 - stream.length)

    return run


def follow(rows: DataFrame, stream: Stream, checkpoint: str):
    """The query that appends a streaming table's rows to a stream."""
    return rows.writeStream.foreachBatch(each_batch(stream)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
