"""SentencePiece encoding with seeded merge-dropout, and decoding.

The agenda of a word's candidate merges is worked off from the best-scored pair on (of equal ones the leftmost); each candidate of each occurrence of a word is skipped
with the dropout rate by a keyed hash of seed, document, copy, place of the word in the text and place of the candidate in the agenda. So every occurrence is cut anew
and reruns agree. The agendas of many words are worked off side by side in numpy: a round takes each word's best candidate. Only what the draws don't change, the cut
of a word if nothing is skipped, serves all occurrences of the word in a group of texts; nothing is held beyond the group. Whatever is skipped, the pieces spell the
text, so decoding gives it back.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.llm.common import mix64, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 17
_SPACE = "▁"
#: Stands for a U+2581 of the text itself, which is spelled in bytes; no other unit has a space sign behind another character.
_LITERAL = "x" + _SPACE
#: Characters that are cut as one group; words of up to _LONGEST characters go side by side, in blocks of rows of about equal length.
_GROUP, _WIDTHS, _BLOCK = 1 << 21, (5, 7, 9, 12, 16, 24, 40), 4096
_LONGEST = _WIDTHS[-1]
_NONE = np.int32(1 << 30)
_STEP = 0x9E3779B97F4A7C15
_PLACE = 0xD1342543DE82EF95
_CHUNKS = re.compile(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+")


def draws(keys: np.ndarray, candidate: int) -> np.ndarray:
    """53-bit numbers: the draw of the candidate (from 0) of each occurrence's agenda."""
    return mix64(keys + np.uint64((candidate + 1) * _STEP % 2**64)) >> np.uint64(11)


class Pieces:
    """The vocabulary of a merge-type SentencePiece model with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.dtype = np.uint16 if n <= 2**16 else np.uint32
        self.ids, self.bytes = {}, {}
        score = {}
        self.table: list[bytes] = [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.table[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                score[piece] = sp.get_score(i)
                self.table[i] = piece.replace(_SPACE, " ").encode()
        self.spelled = np.empty(n, object)
        self.spelled[:] = self.table
        #: Places of the pieces from the best-scored on; a piece's place is its symbol.
        self.rank = {p: r for r, p in enumerate(sorted(score, key=lambda p: (-score[p], self.ids[p])))}
        #: Neighbours within some piece: no merge reaches over any other two, so text can be cut there.
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.cuts_lines = not any("\n" in p for p in self.ids)
        self._symbols()

    def _symbols(self) -> None:
        """Symbols behind the pieces': characters that are in pieces only, then `other` (unknown), `pad` and `gone`. Pairs are found by an open hash table."""
        symbol = dict(self.rank)
        for c in sorted({c for p in self.ids for c in p} - set(symbol)):
            symbol[c] = len(symbol)
        self.other = len(symbol)
        self.pad, self.gone = self.other + 1, self.other + 2
        if self.gone >= 2**16 - 1:
            raise ValueError("the vocabulary has more than 65,000 symbols")
        self.char = np.full(0x110000, self.other, np.int32)
        for s, i in symbol.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        self.id_of = np.full(self.gone + 1, -1, np.int32)
        for p, r in self.rank.items():
            self.id_of[r] = self.ids[p]
        self.byte_ids = np.array([self.bytes[b] for b in range(256)], np.int32)
        known = [(symbol[p[:i]] << 16 | symbol[p[i:]], r) for p, r in self.rank.items() for i in range(1, len(p)) if p[:i] in symbol and p[i:] in symbol]
        self.shift = np.uint32(32 - max(4, (4 * len(known)).bit_length()))
        #: Pair in the high half, symbol in the low one; an empty place has a pair that no two symbols make.
        self.merged = np.full(1 << (32 - int(self.shift)), -1, np.int64)
        left = np.array([k << 32 | r for k, r in known], np.uint64).view(np.int64)
        at = self._home((left >> 32).astype(np.uint32))
        while len(left):
            free = np.flatnonzero(self.merged[at] == -1)
            slots, first = np.unique(at[free], return_index=True)
            took = free[first]
            self.merged[slots] = left[took]
            rest = np.ones(len(left), bool)
            rest[took] = False
            left, at = left[rest], (at[rest] + 1) % len(self.merged)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint32(2654435769)) >> self.shift).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbol of what two symbols spell together, or _NONE."""
        key = (a << np.int32(16) | b).view(np.uint32)
        at = self._home(key)
        found = self.merged.take(at)
        out = found.astype(np.int32)
        miss = np.flatnonzero((found >> 32).astype(np.uint32) != key)
        if len(miss):
            out[miss] = _NONE
            miss = miss[found[miss] != -1]
            while len(miss):
                at[miss] = (at[miss] + 1) & (len(self.merged) - 1)
                found = self.merged.take(at[miss])
                hit = (found >> 32).astype(np.uint32) == key[miss]
                out[miss[hit]] = found[hit].astype(np.int32)
                miss = miss[~hit & (found != -1)]
        return out

    def merge(self, chunk: str, key: int = 0, least: int = 0) -> list[int]:
        """Ids of one chunk by a heap: for chunks of any length. Candidates whose draws by `key` are below `least` are skipped."""
        n, met = len(chunk), 0
        word = list(chunk)
        rank, pop, push = self.rank.get, heapq.heappop, heapq.heappush
        agenda = [(s, i, i + 1, pair) for i in range(n - 1) if (s := rank(pair := chunk[i : i + 2])) is not None]
        if agenda:
            heapq.heapify(agenda)
            left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        while agenda:
            s, i, j, pair = pop(agenda)
            # stale if either side has grown or gone since
            if len(word[i]) + len(word[j]) != len(pair) or right[i] != j:
                continue
            met += 1
            if least and _draw(key, met - 1) < least:
                continue
            word[i], word[j] = pair, ""
            k = right[i] = right[j]
            right[j] = -2
            if k >= 0:
                left[k] = i
                if (s := rank(both := pair + word[k])) is not None:
                    push(agenda, (s, i, k, both))
            if (h := left[i]) >= 0 and (s := rank(both := word[h] + pair)) is not None:
                push(agenda, (s, h, i, both))
        out, ids = [], self.ids.get
        for w in word:
            if w:
                known = ids(w)
                out += [known] if known is not None else [self.bytes[b] for b in w.encode()]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text that encode() was given; its first space is the one that encoding put there."""
        return b"".join(self.spelled.take(ids).tolist()).decode()[1:]


def _draw(key: int, candidate: int) -> int:
    """draws() of one occurrence."""
    x = (key + (candidate + 1) * _STEP) % 2**64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return (x ^ (x >> 31)) >> 11


class Agenda:
    """Words of up to a width, a row each: symbols and the pairs that can merge, to start from as often as is asked."""

    def __init__(self, pieces: Pieces, words: list[str], width: int) -> None:
        self.pieces = pieces
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        inside = np.arange(width) < self.size[:, None]
        self.chars = np.zeros((len(words), width + 2), np.int32)
        self.chars[:, 1:-1][inside] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.symbols = np.full((len(words), width + 2), pieces.pad, np.int32)
        self.symbols[:, 1:-1][inside] = pieces.char.take(self.chars[:, 1:-1][inside])
        literal = [i for i, w in enumerate(words) if w == _LITERAL]
        self.symbols[literal, 1:3] = pieces.other, pieces.pad
        self.chars[literal, 1] = ord(_SPACE)
        self.size[literal] = 1
        self.pairs = np.full(self.symbols.shape, _NONE, np.int32)
        self.pairs[:, 1:-1] = pieces.pair(self.symbols[:, 1:-1].ravel(), self.symbols[:, 2:].ravel()).reshape(-1, width)

    def work(self, rows: np.ndarray, keys: np.ndarray | None = None, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the rows asked for, one behind the other, how many each has, and how many merges it took. keys: an occurrence's draws; without, none is skipped."""
        ids, sizes, merges = [], [], []
        for i in range(0, len(rows), _BLOCK):
            some = rows[i : i + _BLOCK]
            symbols = self._block(some, None if keys is None else keys[i : i + _BLOCK], np.uint64(least))
            out, size, left = self._spelled(some, symbols)
            ids.append(out)
            sizes.append(size)
            merges.append(self.size[some] - left)
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, sizes, merges))

    def _block(self, rows: np.ndarray, keys: np.ndarray | None, least: np.uint64) -> np.ndarray:
        """The rows' symbols when their agendas are empty. A round takes every row's best candidate, so a round's number is that of the candidate."""
        pieces = self.pieces
        symbols, pairs = self.symbols.take(rows, 0), self.pairs.take(rows, 0)
        width = symbols.shape[1]
        after = np.tile(np.arange(1, width + 1), (len(rows), 1))
        before = after - 2
        done, own, round_ = np.empty_like(symbols), np.arange(len(rows)), 0
        while True:
            column = pairs.argmin(1)
            base = np.arange(len(column)) * width
            made = pairs.reshape(-1).take(base + column)
            act = np.flatnonzero(made < _NONE)
            if len(act) < 0.7 * len(made):
                over = np.flatnonzero(made >= _NONE)
                done[own.take(over)] = symbols.take(over, 0)
                symbols, pairs, after, before = (x.take(act, 0) for x in (symbols, pairs, after, before))
                own, keys = own.take(act), keys if keys is None else keys.take(act)
                base, column, made = np.arange(len(act)) * width, column.take(act), made.take(act)
                act = np.arange(len(act))
            elif len(act) < len(made):
                base, column, made = base.take(act), column.take(act), made.take(act)
            if not len(act):
                break
            s, p, a, b = symbols.reshape(-1), pairs.reshape(-1), after.reshape(-1), before.reshape(-1)
            at = base + column
            if keys is not None:
                skip = draws(keys.take(act), round_) < least
                p[at[skip]] = _NONE
                go = np.flatnonzero(~skip)
                base, column, made, at = base.take(go), column.take(go), made.take(go), at.take(go)
            other = base + a.take(at)
            then = a.take(other)
            next_, last = base + then, base + b.take(at)
            s[at], s[other] = made, pieces.gone
            a[at], b[next_] = then, column
            p[other] = _NONE
            n = len(at)
            new = pieces.pair(np.concatenate([made, s.take(last)]), np.concatenate([s.take(next_), made]))
            p[at], p[last] = new[:n], new[n:]
            round_ += 1
        done[own] = symbols
        return done

    def _spelled(self, rows: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, how many a row has, and how many symbols."""
        there = symbols < self.pieces.pad
        size = there.sum(1)
        ids = self.pieces.id_of.take(symbols[there])
        spelled = np.flatnonzero(ids < 0)
        if not len(spelled):
            return ids, size, size
        char = self.chars[rows][there][spelled].astype(np.int64)
        data = np.frombuffer("".join(map(chr, char.tolist())).encode(), np.uint8)
        many = 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)
        each = np.ones(len(ids), np.int64)
        each[spelled] = many
        out = np.repeat(ids, each)
        out[out < 0] = self.pieces.byte_ids[data]
        row = np.repeat(np.arange(len(rows)), size)
        return out, np.bincount(row, each, len(rows)).astype(np.int64), size


class Encoder:
    """Encodes with one rate and seed."""

    def __init__(self, pieces: Pieces, rate: float = DROPOUT, seed: int = SEED) -> None:
        self.pieces, self.rate, self.seed = pieces, rate, seed
        self.least = int(rate * 2**53)

    def variant(self, doc: object, copy: int = 0) -> int:
        """The key of a document's draws; further copies of it have others."""
        return int.from_bytes(hashlib.blake2b(f"{self.seed}:{doc}{f':{copy}' if copy else ''}".encode(), digest_size=8).digest())

    def _parts(self, chunk: str) -> Iterator[str]:
        """A long chunk cut where no piece reaches across."""
        start, joined = 0, self.pieces.joined
        for i in range(1, len(chunk) + 1):
            if chunk[i - 1 : i + 1] not in joined:
                yield chunk[start:i]
                start = i

    def units(self, text: str) -> list[str]:
        """Words with the space signs before them, line ends, and U+2581 of the text itself: no merge reaches across two units."""
        out: list[str] = []
        for i, part in enumerate(text.split(_SPACE)):
            if i:
                out.append(_LITERAL)
            part = part.replace(" ", _SPACE)
            if _SPACE * 2 in part or "\x00" in part:
                chunks = _CHUNKS.findall(part)
            else:
                part = part.replace(_SPACE, "\x00" + _SPACE)
                chunks = (part.replace("\n", "\x00\n\x00") if self.pieces.cuts_lines else part).split("\x00")
            if len(part) > _LONGEST and max(map(len, chunks)) > _LONGEST:
                chunks = [w for c in chunks for w in ((c,) if len(c) <= _LONGEST else self._parts(c))]
            out += chunks
        return out

    def _slices(self, text: str) -> Iterator[str]:
        """The text with a space before it, cut before spaces into slices of about _GROUP characters."""
        text, at = " " + text, 0
        while at < len(text):
            end = text.find(" ", at + _GROUP)
            while end > 0 and text[end - 1] == " ":
                end = text.find(" ", end + 1)
            end = len(text) if end < 0 else end
            yield text[at:end]
            at = end

    def cut(self, units: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one behind the other, and how many each has; keys: of each unit's draws."""
        every = np.empty(len(units), object)
        every[:] = units
        code, words = pd.factorize(every)
        size = np.fromiter(map(len, words), np.int64, len(words))
        store, stored = [], 0
        first, many = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        low = 0
        for width in _WIDTHS:
            some = np.flatnonzero((size > low) & (size <= width))
            low = width
            if not len(some):
                continue
            agenda = Agenda(self.pieces, words[some].tolist(), width)
            ids, sizes, met = agenda.work(np.arange(len(some)))
            place = np.full(len(words), -1, np.int64)
            place[some] = np.arange(len(some))
            row = place[code]
            mine = np.flatnonzero(row >= 0)
            row = row[mine]
            first[mine], many[mine] = stored + (np.cumsum(sizes) - sizes)[row], sizes[row]
            store.append(ids)
            stored += len(ids)
            if not self.least:
                continue
            # an occurrence with a skip among the candidates that its word meets has an agenda of its own
            left, skips = np.flatnonzero(met[row] > 0), []
            for candidate in range(int(met.max(initial=0))):
                hit = draws(keys[mine[left]], candidate) < np.uint64(self.least)
                skips.append(left[hit])
                left = left[~hit]
                left = left[met[row[left]] > candidate + 1]
            own = np.concatenate(skips) if skips else np.zeros(0, np.int64)
            if len(own):
                ids, sizes, _ = agenda.work(row[own], keys[mine[own]], self.least)
                first[mine[own]], many[mine[own]] = stored + np.cumsum(sizes) - sizes, sizes
                store.append(ids)
                stored += len(ids)
        for i in np.flatnonzero(size[code] > _LONGEST).tolist():
            ids = self.pieces.merge(units[i], int(keys[i]), self.least)
            first[i], many[i] = stored, len(ids)
            store.append(np.array(ids, np.int32))
            stored += len(ids)
        flat = np.concatenate(store) if store else np.zeros(0, np.int32)
        at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return flat[at].astype(self.pieces.dtype), many

    def encode_many(self, texts: list[str], variants: list[int]) -> Iterator[np.ndarray]:
        """Ids of each text with a space before it; variants: the keys of the texts' draws. Texts are cut in groups of about _GROUP characters, long ones in slices."""
        units: list[str] = []
        keys: list[np.ndarray] = []
        ends: list[int] = []
        head: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[np.ndarray]:
            nonlocal units, keys, ends, size
            ids, many = self.cut(units, np.concatenate(keys)) if units else (np.zeros(0, self.pieces.dtype), np.zeros(0, np.int64))
            total, start = np.concatenate([[0], np.cumsum(many)]), 0
            for e in ends:
                yield np.concatenate([*head, ids[start : total[e]]])
                head.clear()
                start = total[e]
            head.append(ids[start:])
            units, keys, ends, size = [], [], [], 0

        for text, variant in zip(texts, variants, strict=True):
            place = 0
            for part in self._slices(text):
                found = [u for u in self.units(part) if u]
                units += found
                where = np.arange(place, place + len(found), dtype=np.uint64)
                keys.append(mix64(where * np.uint64(_PLACE) + np.uint64(variant)))
                place += len(found)
                size += len(part)
                if size >= _GROUP:
                    yield from flush()
            ends.append(len(units))
        yield from flush()

    def encode(self, text: str, variant: int = 0) -> np.ndarray:
        """Ids of one text. A literal U+2581 is spelled in bytes, so it isn't taken for a space."""
        return next(self.encode_many([text], [variant]))


@functools.lru_cache(2)
def _pieces(path: str) -> Pieces:
    """One a worker process: the vocabulary's tables, nothing of the texts."""
    return Pieces(path)


def encode(docs: DataFrame, keep: list[str], path: str = MODEL, rate: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """docs' columns `keep` with n_tokens, ids (little-endian numbers of the vocabulary's width), ids_sha256 and lossless: whether decoding gave the text back.

    docs needs doc_id and text. Rows of equal doc_id that follow each other, as mixing's copies do, are cut by draws of their own; a null doc_id has its draws like any
    other. A null text has 0 tokens, empty ids and lossless true; an empty text has the one id of its leading space. Long texts are cut whole, in slices that bound what
    is held; only a run of more than 40 characters without a place to cut is worked off alone. An empty table gives no rows. No shuffle; the model file must be at
    `path` on every executor.
    """
    small_batches(docs.sparkSession)
    own = [f"c{i}" for i in range(len(keep))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder(_pieces(path), rate, seed)
        before, copy = object(), 0
        for pdf in batches:
            variants = []
            for doc in pdf.pop("__doc"):
                copy = copy + 1 if doc == before else 0
                before = doc
                variants.append(enc.variant(doc, copy))
            texts = pdf.pop("__text").tolist()
            some = [i for i, t in enumerate(texts) if t is not None]
            rows = [(0, b"", hashlib.sha256(b"").hexdigest(), True)] * len(texts)
            for i, ids in zip(some, enc.encode_many([texts[i] for i in some], [variants[i] for i in some]), strict=True):
                data = ids.tobytes()
                rows[i] = (len(ids), data, hashlib.sha256(data).hexdigest(), enc.pieces.decode(ids) == texts[i])
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=["n_tokens", "ids", "ids_sha256", "lossless"])], axis=1)

    schema = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(own, keep, strict=True))
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for n, c in zip(own, keep, strict=True)), F.col("doc_id").cast("string").alias("__doc"), F.col("text").alias("__text"))
    out = rows.mapInPandas(run, schema + ", n_tokens long, ids binary, ids_sha256 string, lossless boolean")
    return out.select(*(F.col(n).alias(c) for n, c in zip(own, keep, strict=True)), "n_tokens", "ids", "ids_sha256", "lossless")
