"""What the training-data operators share: word hashing, shared storage, size-checked joins."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vexil.sources.shared import drop_since, fresh_path, mark, maybe_broadcast, shared_dir, stash

__all__ = [
    "drop_since", "free_name", "fresh_path", "hash_words", "lower_ascii", "lower_str", "mark", "maybe_broadcast", "mix64", "parts", "shared_dir", "shingle_sets", "small_batches", "stash", "whole",
]

WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_SEGMENT = 1 << 20


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def lower_str(text: str) -> str:
    """The same for a Python string: bytes know ASCII letters only."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def whole(rows: DataFrame, name: str = "row") -> Column:
    """All columns as one struct, so that names of an operator's own can't clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias(name)


def parts(rows: DataFrame, name: str = "row") -> list[Column]:
    """The columns of rows out of that struct."""
    return [F.col(f"{name}.`{c}`").alias(c) for c in rows.columns]


def free_name(name: str, taken: list[str]) -> str:
    """name, or name_2, name_3 and so on if columns are called so, in whatever case."""
    used = {c.lower() for c in taken}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(2, len(used) + 3))) if n.lower() not in used)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of fewer rows, so that a batch of long texts stays small; a session's own setting stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the odd base and of its inverse modulo 2**64, grown as segments ask for them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_BASE, -1, 2**64)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, inverse))
        return self.up, self.down


_POWERS = _Powers()


def hash_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts in order, and the offset at which each text's words begin (one more offset at the end).

    The bytes of all texts are hashed in segments of about a megabyte, cut at white space, so that memory doesn't follow the longest text.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(b) + 1 for b in raw), np.int64, len(raw))
    data = _LOWER[np.frombuffer(b" ".join([*raw, b""]), np.uint8)] if raw else np.zeros(0, np.uint8)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    starts_all, hashes = [], []
    at = 0
    while at < len(data):
        end = min(at + _SEGMENT, len(data))
        while end < len(data) and not _SPACE[data[end - 1]]:
            step = _SPACE[data[end : end + _SEGMENT]]
            end += int(step.argmax()) + 1 if step.any() else len(step)
        part = data[at:end]
        inside = ~_SPACE[part]
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _POWERS.to(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
        hashes.append(mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
        starts_all.append(s + at)
        at = end
    starts = np.concatenate(starts_all) if starts_all else np.zeros(0, np.int64)
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return words, np.searchsorted(starts, bounds)


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Per text its sorted distinct hashes of runs of `width` words; with fewer words, one of the whole run; without words, none."""
    words, at = hash_words(texts)
    for i in range(len(texts)):
        w = words[at[i] : at[i + 1]]
        if len(w) == 0:
            yield w
            continue
        n = max(1, len(w) - width + 1)
        used = min(width, len(w))
        h = np.full(n, used, np.uint64)
        for j in range(used):
            h = mix64(h * np.uint64(0x2545F4914F6CDD1D) + w[j : j + n])
        h.sort()
        yield h[np.concatenate([[True], h[1:] != h[:-1]])]
