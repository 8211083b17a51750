"""Language-model scoring: causal self-attention over subword ids, trained in numpy, and a word-count base beside it.

Subword ids are dealt to slots: the most frequent ids have one each, the others share slots by frequency, with the id's share of its slot from the counts of the whole
training corpus. Slots form groups; the model gives the group, then the slot in it. Its logits are those of slot pairs counted over the whole corpus, plus what one
causal attention head adds from up to CONTEXT slots before, whose weights are learned by gradient descent on every training document: in each round every task streams
its own documents of that round through, from the same start, and Spark averages the weights. Training data, counts and work follow the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.llm import materialise
from vexil.llm.common import hash_words, lower_str, small_batches, stash

GROUPS = GROUP = 32
SLOTS, ALONE = GROUPS * GROUP, GROUPS * GROUP - 64
START, PAD = SLOTS, SLOTS + 1
#: Width of a head; positions a window scores; positions before them that it only looks at.
WIDTH, STRIDE, CONTEXT = 16, 32, 16
WINDOW = STRIDE + CONTEXT
#: Every training document is in one of the rounds.
ROUNDS, RATE, BATCH = 2, 0.04, 96
SMOOTH = 20.0
#: Words above this share of all training words are sent to the tasks (a million at most, by arithmetic); rarer ones are joined.
FREQUENT = 1e-6
_AT_ONCE = 256
_TOKENS = 200_000
_HELD = 1 << 20


def slots_of(counts: np.ndarray) -> np.ndarray:
    """The slot of each id: the ALONE most frequent in order, then the rest in the other slots, each of about equal weight (no id is without one)."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    out = np.empty(len(counts), np.int32)
    out[order[:ALONE]] = np.arange(min(ALONE, len(order)))
    rest = order[ALONE:]
    if len(rest):
        weight = np.cumsum(counts[rest] + 1.0)
        out[rest] = ALONE + np.minimum(((weight - 1) / weight[-1] * (SLOTS - ALONE)).astype(np.int32), SLOTS - ALONE - 1)
    # neighbours in frequency go to different groups
    return (out % GROUPS) * GROUP + out // GROUPS


def windows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all documents: inputs [W, WINDOW] (what is known before each target), targets [W, STRIDE] (-1: none), and the document of each window.

    Each target is in one window; a window's first CONTEXT inputs are the end of the window before.
    """
    n = np.array([len(d) for d in docs])
    many = -(-n // STRIDE)
    size = CONTEXT + many * STRIDE
    at = np.concatenate([[0], np.cumsum(size)])
    known, goal = np.full(at[-1], PAD, np.int32), np.full(at[-1], -1, np.int32)
    for d, a in zip(docs, at[:-1].tolist(), strict=True):
        a += CONTEXT
        known[a] = START
        known[a + 1 : a + len(d)] = d[:-1]
        goal[a : a + len(d)] = d
    of = np.repeat(np.arange(len(docs)), many)
    first = at[of] + (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    return known[first[:, None] + np.arange(WINDOW)], goal[first[:, None] + CONTEXT + np.arange(STRIDE)], of


_BACK = CONTEXT + np.arange(STRIDE)[:, None] - np.arange(WINDOW)
_CAUSAL = (_BACK >= 0).astype(np.float32)
_FAR = np.maximum(_BACK, 0)
_SCALE = np.float32(WIDTH**-0.5)
_BOUND = 4.0


@dataclass
class Weights:
    """What is learned: tables of queries, keys and values by slot, a bias by distance, and the output maps."""

    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    far: np.ndarray
    w1: np.ndarray
    w2: np.ndarray

    @staticmethod
    def start(seed: int = 11) -> Weights:
        rng = np.random.default_rng(seed)
        table = lambda s: (rng.standard_normal((SLOTS + 2, WIDTH)) * s).astype(np.float32)
        return Weights(table(0.3), table(0.3), table(0.5), np.zeros(WINDOW, np.float32), np.zeros((WIDTH, GROUPS), np.float32), np.zeros((GROUPS, WIDTH, GROUP), np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in vars(self).values()])

    @staticmethod
    def shaped(flat: np.ndarray) -> Weights:
        return Weights(*(flat[a:b].reshape(shape).astype(np.float32, copy=False) for a, b, shape in zip([0, *_ENDS], _ENDS, _SHAPES, strict=False)))


_SHAPES = [x.shape for x in vars(Weights.start()).values()]
_ENDS = np.cumsum([np.prod(x) for x in _SHAPES]).tolist()
#: Sums along rows of GROUP or WIDTH numbers are products with ones: numpy's own sums of short rows cost more.
_ONES = np.ones(max(GROUP, GROUPS, WIDTH), np.float32)


def _summed(rows: np.ndarray, grad: np.ndarray) -> np.ndarray:
    """grad's rows summed by slot: sorted by slot, then added up a run at a time."""
    rows = rows.ravel().astype(np.uint16)
    order = rows.argsort(kind="stable")
    sorted_ = rows[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    out = np.zeros((SLOTS + 2, grad.shape[-1]), np.float32)
    # two columns at a time, as the parts of a complex number: reduceat costs a call a run and column
    pairs = np.ascontiguousarray(grad, np.float32).reshape(len(rows), -1).view(np.complex64)
    out.view(np.complex64)[sorted_[first]] = np.add.reduceat(pairs.take(order, 0), first, axis=0)
    return out


@dataclass
class Moments:
    """What Adam carries from one chunk of a task's documents to the next: steps, chunks, and the two moments (10 and 100 times)."""

    steps: int = 0
    chunks: int = 0
    m: np.ndarray | float = 0.0
    s: np.ndarray | float = 0.0


@dataclass
class Model:
    """slot of each id, log share of each id in its slot, log probabilities of pairs as group and in-group tables (the latter a group at a time,
    since a batch is scored that way), and the learned weights."""

    slot: np.ndarray
    inside: np.ndarray
    base1: np.ndarray
    base2: np.ndarray
    weights: Weights = field(default_factory=Weights.start)

    @staticmethod
    def counted(slot: np.ndarray, ids: np.ndarray, pairs: np.ndarray) -> Model:
        """From counts of ids and of slot pairs [SLOTS + 2, SLOTS]; an id that wasn't seen counts as seen once."""
        one = ids + 1.0
        total = np.bincount(slot, one, SLOTS)
        uni = (total + 1e-9) / total.sum()
        p = (pairs + SMOOTH * uni) / (pairs.sum(1, keepdims=True) + SMOOTH)
        p = p.reshape(SLOTS + 2, GROUPS, GROUP)
        group = p.sum(2)
        return Model(slot, np.log(one / total[slot]).astype(np.float32), np.log(group).astype(np.float32), np.ascontiguousarray(np.log(p / group[:, :, None]).transpose(1, 0, 2), np.float32))

    def attend(self, known: np.ndarray) -> tuple[np.ndarray, ...]:
        """Batched masked attention of the last STRIDE positions of each window over the window: slots that ask, (queries, keys, values, weights), sums of weights, what came out.

        A column of ones beside the values sums the weights; both are zero for PAD, so padding counts in neither. The tables are bounded, so exp can't overflow.
        """
        w = self.weights
        asks = known[:, CONTEXT:]
        values = np.concatenate([w.v, np.ones((SLOTS + 2, 1), np.float32)], 1)
        values[PAD] = 0
        q, k, v = (w.q * _SCALE).take(asks, 0), w.k.take(known, 0), values.take(known, 0)
        score = q @ k.transpose(0, 2, 1)
        np.exp(score, out=score)
        score *= np.exp(w.far)[_FAR] * _CAUSAL
        seen = score @ v
        total = np.maximum(seen[..., WIDTH:], np.float32(1e-30))
        return asks, (q, k, v, score), total, seen[..., :WIDTH] / total

    def grouped(self, asks: np.ndarray, seen: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of all targets that are there, in order of their groups: their index, group, place in it, output of attention, logits of groups and of places, and the bounds
        of each group's targets, which are one slice: so there is one table look-up for all, and a product a group."""
        real = np.flatnonzero(goal.ravel() >= 0)
        group, place = np.divmod(goal.ravel().take(real), GROUP)
        order = group.astype(np.uint8).argsort(kind="stable")
        real, group, place = real.take(order), group.take(order), place.take(order)
        asks, seen = asks.ravel().take(real), seen.reshape(-1, WIDTH).take(real, 0)
        ends = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        l1 = self.base1.take(asks, 0)
        l1 += seen @ self.weights.w1
        l2 = self.base2.reshape(-1, GROUP).take(group * np.int32(SLOTS + 2) + asks, 0)
        more = np.empty_like(l2)
        for w, a, b in zip(self.weights.w2, ends, ends[1:], strict=False):
            np.dot(seen[a:b], w, out=more[a:b])
        l2 += more
        return real, group, place, seen, l1, l2, ends

    def log_probs(self, known: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """Natural log probability of each target's slot; 0 where there is none."""
        asks, _, _, seen = self.attend(known)
        out = np.zeros(goal.size, np.float64)
        real, group, place, _, l1, l2, _ = self.grouped(asks, seen, goal)
        at = np.arange(len(real))
        got = l1[at, group] + l2[at, place]
        got -= np.log(np.exp(l1, out=l1) @ _ONES[:GROUPS])
        got -= np.log(np.exp(l2, out=l2) @ _ONES[:GROUP])
        out[real] = got
        return out.reshape(-1, STRIDE)

    def gradient(self, known: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """Of the mean negative log probability, flat."""
        w = self.weights
        asks2, (q, k, v, p), total, seen2 = self.attend(known)
        real, group, place, seen, d1, d2, ends = self.grouped(asks2, seen2, goal)
        n, at = np.float32(1 / max(1, len(real))), np.arange(len(real))
        np.exp(d1, out=d1)
        np.exp(d2, out=d2)
        d1 *= (n / (d1 @ _ONES[:GROUPS]))[:, None]
        d1[at, group] -= n
        d2 *= (n / (d2 @ _ONES[:GROUP]))[:, None]
        d2[at, place] -= n
        dw1, dseen = seen.T @ d1, d1 @ w.w1.T
        dw2, more = np.zeros_like(w.w2), np.empty_like(dseen)
        for g, a, b in zip(range(GROUPS), ends, ends[1:], strict=False):
            np.dot(seen[a:b].T, d2[a:b], out=dw2[g])
            np.dot(d2[a:b], w.w2[g].T, out=more[a:b])
        dseen += more
        # weights are left undivided: their sum divides what comes from above instead
        dseen /= total.ravel().take(real)[:, None]
        # beside it the softmax's own term, which meets the column of ones: the product of what came out with its gradient; a last row of zeros is for what isn't there
        dout = np.zeros((len(real) + 1, WIDTH + 1), np.float32)
        dout[:-1, :WIDTH] = dseen
        dseen *= seen
        np.negative(dseen @ _ONES[:WIDTH], out=dout[:-1, WIDTH])
        row = np.full(goal.size, len(real))
        row[real] = at
        dout = dout.take(row, 0).reshape(*goal.shape, WIDTH + 1)
        # queries, keys and values side by side are summed by slot at once; the first CONTEXT positions ask nothing
        dqkv = np.empty((*known.shape, 3 * WIDTH), np.float32)
        dqkv[:, :CONTEXT, :WIDTH] = 0
        np.matmul(p.transpose(0, 2, 1), dout[..., :WIDTH], out=dqkv[..., 2 * WIDTH :])
        ds = dout @ v.transpose(0, 2, 1)
        ds *= p
        dfar = np.bincount(_FAR.ravel(), np.ones(len(ds), np.float32) @ ds.reshape(len(ds), -1), WINDOW)
        np.matmul(ds, k, out=dqkv[:, CONTEXT:, :WIDTH])
        np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[..., WIDTH : 2 * WIDTH])
        sums = _summed(known, dqkv)
        sums[:, :WIDTH] *= _SCALE
        # padding's values are zero whatever its row says
        sums[PAD, WIDTH:] = 0
        return Weights(sums[:, :WIDTH], sums[:, WIDTH : 2 * WIDTH], sums[:, 2 * WIDTH :], dfar.astype(np.float32), dw1, dw2).flat()

    def fit(self, docs: list[np.ndarray], seed: int, state: Moments | None = None) -> int:
        """Adam over the windows of docs, once, in seeded order, changing the weights; returns the number of targets.

        state goes on from the chunk before; each chunk begins at a smaller rate than the one before and ends at a tenth of it.
        """
        state = state or Moments()
        known, goal, _ = windows(docs)
        order = np.random.default_rng([seed, state.chunks] if state.chunks else seed).permutation(len(known))
        flat = self.weights.flat()
        steps = range(0, len(order), BATCH)
        for j, i in enumerate(steps, 1):
            part = order[i : i + BATCH]
            g = self.gradient(known[part], goal[part])
            state.steps = t = state.steps + 1
            if t == 1:
                state.m, state.s = np.zeros_like(g), np.zeros_like(g)
            rate = RATE * min(1.0, t / 20) * (1.0 - 0.9 * j / len(steps)) / (1 + state.chunks) ** 0.5
            # the moments are kept 10 and 100 times as large, which their quotient takes back: fewer passes over the weights
            state.m *= np.float32(0.9)
            state.m += g
            state.s *= np.float32(0.99)
            g *= g
            state.s += g
            root = 0.1 / (1 - 0.99**t) ** 0.5
            step = np.sqrt(state.s, out=g)
            step += np.float32(1e-6 / root)
            np.divide(state.m, step, out=step)
            step *= np.float32(0.1 * rate / (1 - 0.9**t) / root)
            flat -= step
            np.clip(flat, -_BOUND, _BOUND, out=flat)
            self.weights = Weights.shaped(flat)
        state.chunks += 1
        return int((goal >= 0).sum())

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each list of ids."""
        out, at = np.zeros(len(docs)), 0
        while at < len(docs):
            end, size = at, 0
            while end < len(docs) and size < _TOKENS:
                size += len(docs[end])
                end += 1
            part = docs[at:end]
            known, goal, of = windows([self.slot[d] for d in part])
            for i in range(0, len(known), _AT_ONCE):
                some = slice(i, i + _AT_ONCE)
                out[at:end] += np.bincount(of[some], self.log_probs(known[some], goal[some]).sum(1), len(part))
            out[at:end] += np.bincount(np.repeat(np.arange(len(part)), [len(d) for d in part]), self.inside[np.concatenate(part)], len(part))
            at = end
        return out / np.log(10)


def ids_of(text: str | None, path: str) -> np.ndarray:
    """Subword ids of the lower-cased text and the end id."""
    return materialise.tokens(path).ids(lower_str(text or "")).astype(np.int32)


def _round(rows: DataFrame, round_: int) -> DataFrame:
    """Training documents of one of ROUNDS equal parts by a hash of the id; each document is in one."""
    return rows.filter("learn").filter(f"pmod(xxhash64(doc_id, 3), {ROUNDS}) = {round_}")


def prepared(docs: DataFrame, path: str = materialise.RANKS) -> DataFrame:
    """(row, doc_id, learn, held_out, text, ids) for docs(doc_id, text), written once: texts are tokenised once, and every later step reads its columns from there.

    A null doc_id has no remainder: it is neither held out nor learned from. A null text counts as empty.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([ids_of(t, path).astype("<u2").tobytes() for t in texts])

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    held = F.coalesce(fold == 2, F.lit(False)).alias("held_out")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold != 2, F.lit(False)).alias("learn"), held, F.coalesce("text", F.lit("")).alias("text"))
    return stash(rows.withColumn("ids", cut("text")), "tokens")


def _ids(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2").astype(np.int32) for x in column]


def _tally_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> pd.DataFrame:
        keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return pd.DataFrame({"h": keys.view(np.int64), "c": np.bincount(back, np.concatenate([n for _, n in held])).astype(np.int64)})

    for pdf in batches:
        held.append(np.unique(hash_words(pdf["text"].tolist())[0], return_counts=True))
        size += len(held[-1][0])
        if size > _HELD:
            yield merged()
            held, size = [], 0
    if held:
        yield merged()


def _tally_ids(slot: np.ndarray | None):
    """Rows (key, n): ids, and from 2**20 on slot pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = np.zeros(materialise.END + 1, np.int64)
        pairs = np.zeros((SLOTS + 2) * SLOTS if slot is not None else 0, np.int64)
        for pdf in batches:
            docs = _ids(pdf["ids"])
            if not docs:
                continue
            flat = np.concatenate(docs)
            ids += np.bincount(flat, minlength=len(ids))
            if slot is not None:
                s = slot[flat]
                before = np.concatenate([[START], s[:-1]])
                before[np.cumsum([0, *(len(d) for d in docs[:-1])])] = START
                np.add.at(pairs, before * SLOTS + s, 1)
        for first, n in ((0, ids), (_PAIRS, pairs)):
            some = np.flatnonzero(n)
            yield pd.DataFrame({"key": some + first, "n": n[some]})

    return run


_PAIRS = 1 << 20


def _gathered(rows: DataFrame, slot: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Counts of ids and of slot pairs over all rows: at most as many numbers as the vocabulary and the pairs of slots have."""
    got = rows.select("ids").mapInPandas(_tally_ids(slot), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(_PAIRS + (SLOTS + 2) * SLOTS)
    out[got["key"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.float64)
    return out[: materialise.END + 1], out[_PAIRS:]


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[list[np.ndarray]]:
    """All documents in order, in lists that end as soon as they have _TOKENS ids."""
    docs, size = [], 0
    for pdf in batches:
        for x in _ids(pdf["ids"]):
            docs.append(x)
            size += len(x)
            if size >= _TOKENS:
                yield docs
                docs, size = [], 0
    if docs:
        yield docs


def _trained(model: Model, round_: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state, n = Model(model.slot, model.inside, model.base1, model.base2, model.weights), Moments(), 0
        for docs in _chunks(batches):
            n += own.fit([model.slot[x] for x in docs], round_, state)
        if n:
            flat = own.weights.flat().astype(np.float64)
            yield pd.DataFrame({"i": np.arange(len(flat)), "x": flat * n, "n": float(n)})

    return run


@dataclass
class Fitted:
    """The model, the table of word counts by hash, and what all training tokens, distinct ones, ends, and ids that gradient descent has seen number."""

    model: Model
    words: DataFrame
    n: int
    v: int
    ends: int
    fitted: int = 0


def train(rows: DataFrame) -> Fitted:
    """Learns from the prepared rows with `learn`.

    To the driver come id counts, slot-pair counts and averaged weights only: as many as the model has, whatever the corpus. Word counts stay a table, summed in
    each task before the shuffle.
    """
    learn = rows.filter("learn")
    slot = slots_of(_gathered(learn, None)[0])
    ids, pairs = _gathered(learn, slot)
    model = Model.counted(slot, ids, pairs.reshape(SLOTS + 2, SLOTS))
    fitted = 0
    for r in range(ROUNDS):
        own = _round(rows, r).select("ids")
        sent = own.mapInPandas(_trained(model, r), "i int, x double, n double").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x"), F.sum("n").alias("n")).toPandas()
        if len(sent):
            fitted += int(sent["n"].iloc[0])
            model.weights = Weights.shaped(sent.sort_values("i")["x"].to_numpy())
    words = stash(learn.select("text").mapInPandas(_tally_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "words")
    ends = learn.count()
    v, n = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    return Fitted(model, words, n + ends, v + (ends > 0), ends, fitted)


def score(rows: DataFrame, fitted: Fitted) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each prepared row.

    base_score sums log10((c + 1) / (n + v + 1)) over words and end. Words above FREQUENT are looked up in the task; for rarer ones (row, hash, times) is joined with
    the table of counts: none of these has more than a millionth of all words, so no key is hot. An empty text has its end only.
    """
    spark, n = rows.sparkSession, fitted.n
    often = fitted.words.filter(F.col("c") >= max(1, int(FREQUENT * n))).toPandas()
    keys = often["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = keys.argsort()
    sent = spark.sparkContext.broadcast((keys[order], np.log10(often["c"].to_numpy(dtype=np.float64)[order] + 1), fitted.model))
    end_gain, end_known = float(np.log10(fitted.ends + 1)), int(fitted.ends > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, gains, model = sent.value
        for pdf in batches:
            row, m = pdf["row"].to_numpy(), len(pdf)
            words, at = hash_words(pdf["text"].tolist())
            doc = np.repeat(np.arange(m), np.diff(at))
            some, back = np.unique(words, return_inverse=True)
            place = np.searchsorted(keys, some)
            there = keys[np.minimum(place, len(keys) - 1)] == some if len(keys) else np.zeros(len(some), bool)
            gain = np.zeros(len(some))
            gain[there] = gains[place[there]]
            known = there[back]
            base = {"row": row, "tokens": np.diff(at) + 1, "known": np.bincount(doc, known, m).astype(np.int64) + end_known, "gain": np.bincount(doc, gain[back], m) + end_gain}
            yield pd.DataFrame(base | {"h": pd.array([None] * m, "Int64"), "score": model.scores(_ids(pdf["ids"])), "doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"].to_numpy()})
            rare = np.flatnonzero(~known)
            if len(rare):
                order = np.lexsort((words[rare], doc[rare]))
                d, h = doc[rare][order], words[rare][order]
                first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])]))
                times = {"row": row[d[first]], "tokens": np.diff(np.append(first, len(d))), "known": 0, "gain": 0.0, "h": h[first].view(np.int64), "score": 0.0}
                yield pd.DataFrame(times | {"doc_id": pd.array([None] * len(first), "Int64"), "held_out": False})

    schema = "row long, tokens long, known long, gain double, h long, score double, doc_id long, held_out boolean"
    made = stash(rows.select("row", "doc_id", "held_out", "text", "ids").mapInPandas(run, schema), "scored")
    rare = made.filter("h is not null").select("row", "tokens", "h").join(fitted.words, "h")
    more = rare.groupBy("row").agg(F.sum("tokens").alias("more"), F.sum(F.col("tokens") * F.log10(F.col("c") + 1)).alias("add"))
    out = made.filter("h is null").join(more, "row", "left")
    per = float(np.log10(n + fitted.v + 1))
    return out.select(
        "doc_id",
        "held_out",
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("gain") + F.coalesce("add", F.lit(0.0)) - F.col("tokens") * per).alias("base_score"),
        "score",
    )


def train_and_score(docs: DataFrame, path: str = materialise.RANKS) -> DataFrame:
    """score() of docs(doc_id, text) by what train() learns from its own training documents."""
    rows = prepared(docs, path)
    return score(rows, train(rows))
