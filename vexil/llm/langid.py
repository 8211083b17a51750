"""Language identification by rank order: a text's most frequent n-grams against each language's profile, by out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vexil.llm.common import free_name, parts, small_batches, stash, whole

#: n-grams of 1 to 3 letters (words padded by blanks); so many ranks a profile; so many of a text.
GRAMS, RANKS, TEXT_RANKS = 3, 400, 300
_KEEP = 1 << 19
_STEP = 1 << 20


def codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run of other characters than letters made one blank; blanks at both ends."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters(raw)
    c = np.where(letter, raw, 32).astype(np.int64)
    c = np.concatenate([[32], c, [32]])
    return c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]


_KNOWN: dict[int, bool] = {}
_ASCII = np.array([chr(i).isalpha() for i in range(0x3000)])


def _letters(raw: np.ndarray) -> np.ndarray:
    out = _ASCII[np.minimum(raw, 0x2FFF)]
    if raw.size and raw.max() >= 0x3000:
        high = np.flatnonzero(raw >= 0x3000)
        out[high] = [_KNOWN.setdefault(x, chr(x).isalpha()) for x in raw[high].tolist()]
    return out


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams as numbers (21 bits a character), and their counts. Long texts are counted in steps and summed."""
    c = codes(text)
    parts = []
    for at in range(0, max(1, len(c)), _STEP):
        p = c[at : at + _STEP + GRAMS - 1]
        n = min(_STEP, len(c) - at)
        rolled = [p[:n][p[:n] != 32]]
        key = p[:n]
        for k in range(1, GRAMS):
            key = (key[: max(0, len(p) - k)] << 21) | p[k : k + len(key)]
            rolled.append(key)
        parts.append(_runs(np.concatenate(rolled)))
    if len(parts) == 1:
        return parts[0]
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x.sort()
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


def top(keys: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent, most frequent first; of equally frequent ones the smaller number first."""
    order = np.lexsort((keys, -counts))[:n] if len(keys) <= 4 * n else None
    if order is None:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        some = np.flatnonzero(counts >= least)
        order = some[np.lexsort((keys[some], -counts[some]))[:n]]
    return keys[order]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, list] = {}
    size = 0

    def flush() -> Iterator[pd.DataFrame]:
        for lang, parts in held.items():
            keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            yield pd.DataFrame({"lang": lang, "gram": keys, "n": np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)})
        held.clear()

    for pdf in batches:
        for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
            k, n = grams(text)
            held.setdefault(lang, []).append((k, n))
            size += len(k)
            if size > _KEEP * 4:
                yield from flush()
                size = 0
    yield from flush()


def train(docs: DataFrame, ranks: int = RANKS) -> DataFrame:
    """(lang, rank from 0, gram): the `ranks` most frequent n-grams of each language over all rows of docs(text, lang) with neither null.

    Counts are summed in each task before they are shuffled by (lang, gram), so a hot language isn't one task's; the ranking window drops all but the first
    `ranks` rows of each task before its own shuffle.
    """
    small_batches(docs.sparkSession)
    counts = docs.filter("text is not null and lang is not null").select("text", "lang").mapInPandas(_count, "lang string, gram long, n long")
    totals = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return totals.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < ranks).select("lang", "rank", "gram")


class Profiles:
    """Ranks of all languages in one sorted table: a text is compared with every language at once."""

    def __init__(self, rows: list[tuple[str, int, int]], ranks: int = RANKS) -> None:
        self.langs = sorted({r[0] for r in rows})
        self.ranks = ranks
        at = {x: i for i, x in enumerate(self.langs)}
        self.keys = np.array(sorted({r[2] for r in rows}), np.int64)
        self.places = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int32)
        for lang, rank, gram in rows:
            self.places[np.searchsorted(self.keys, gram), at[lang]] = rank

    def judge(self, text: str | None) -> tuple[str, float]:
        """The language of least out-of-place distance (ties: first by name) and its closeness, 1 at distance 0 and 0 at the largest; `und`, 0 for no letters."""
        if not text or not self.langs:
            return "und", 0.0
        keys, counts = grams(text)
        if not len(keys) or keys[-1] == 32 or not (keys != 32).any():
            return "und", 0.0
        best = top(keys, counts, TEXT_RANKS)
        at = np.searchsorted(self.keys, best)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != best)] = len(self.keys)
        place = self.places[at]
        off = np.where(place < 0, self.ranks, np.abs(place - np.arange(len(best), dtype=np.int32)[:, None])).clip(max=self.ranks).sum(0)
        i = int(off.argmin())
        return self.langs[i], float(1.0 - off[i] / (self.ranks * len(best)))


def predict(docs: DataFrame, profiles: DataFrame, names: tuple[str, str] | None = ("lang_pred", "score"), least: float | None = None) -> DataFrame:
    """docs with two more columns, the predicted language and its closeness, from docs.text alone; with `least`, only rows that have a language and are as close.

    Columns of the input that are called so stay, and the new one is called name_2; without names none is added. Long texts are judged whole; a tie goes to the
    first language by name.

    The profiles (ranks times languages, so bounded by the labels in use) are gathered and sent with the task; null texts and texts without letters are `und`
    with score 0. An empty training table leaves `und` everywhere.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(Profiles([tuple(r) for r in profiles.select("lang", "rank", "gram").collect()]))
    said = "lang string, score double"

    @F.pandas_udf(said)
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([model.value.judge(t) for t in batch], columns=["lang", "score"])

    out = docs.select(whole(docs), judge(F.col("text")).alias("said"))
    if least is not None:
        out = out.filter((F.col("said.lang") != "und") & (F.col("said.score") >= least))
    said_as = [F.col(f"said.{c}").alias(free_name(n, docs.columns)) for c, n in zip(("lang", "score"), names, strict=True)] if names else []
    return out.select(*parts(docs), *said_as)


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): profiles from documents whose crc32(doc_id) mod `folds` isn't `held`; every document is judged.

    A null doc_id has no remainder: it is never held out and never learned from.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    profiles = stash(train(docs.filter(fold != held)), "profiles")
    rows = docs.select("doc_id", "text", F.coalesce(fold == held, F.lit(False)).alias("held_out"))
    return predict(rows, profiles).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.05) -> DataFrame:
    """Of docs(text, lang, ...), with their columns, those whose text has a language: texts without letters, or closer than `least` to no profile, go.

    Null and empty texts have no letters. Repeated rows are judged alike; a null lang isn't learned from; if no row has one, nothing has a language and all go. An empty
    table gives no rows.
    """
    return predict(docs, stash(train(docs), "profiles"), None, least)
