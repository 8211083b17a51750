"""Scores of an answer against what was expected, as column expressions; two metrics that SQL lacks are Arrow UDFs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUNCTUATION = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
LETTERS = "ABCD"


def normalize(text: Column) -> Column:
    """Lower case, ASCII punctuation dropped, articles a, an and the blanked, white space collapsed."""
    bare = F.regexp_replace(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " "), r"\s+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _bound(of: Column, use) -> Column:
    """use(value) with the value computed once: in a lambda it is a variable, not an expression that is computed again at each place."""
    return F.get(F.transform(F.array(of), use), F.lit(0))


def _common(a: Column, b: Column) -> Column:
    """Size of the bag intersection; only words of both are counted."""
    times = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, w: s + F.least(times(a, w), times(b, w)))


def f1(prediction: Column, truth: Column) -> Column:
    """F1 of bags of normalized words; 0 without a common word."""
    bags = F.struct(words(normalize(prediction)).alias("a"), words(normalize(truth)).alias("b"))
    sizes = _bound(bags, lambda p: F.struct(_common(p["a"], p["b"]).cast("double").alias("same"), F.size(p["a"]).alias("a"), F.size(p["b"]).alias("b")))

    def score(n: Column) -> Column:
        precision, recall = n["same"] / F.greatest(F.lit(1), n["a"]), n["same"] / F.greatest(F.lit(1), n["b"])
        return F.when(n["same"] == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))

    return _bound(sizes, score)


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: a row of the table is one number, a bit a word of a, so a step is a few operations on whole rows."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for y in b:
        met = row & at.get(y, 0)
        row = ((row + met) | (row - met)) & every
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def rouge_l(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """F of the longest common subsequence of words; 0 for null or no words."""
    for a, b in batches:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = (x or "").split(), (y or "").split()
            n = _lcs(x, y)
            out.append(2.0 * n / (len(x) + len(y)) if n else 0.0)
        yield pd.Series(out)


def _longest(x: str, y: str) -> tuple[int, int, int]:
    """(length, place in x, place in y) of the longest common substring, the first in x and then in y, by a suffix automaton of y: time follows the lengths' sum."""
    step: list[dict[str, int]] = [{}]
    link, size, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(y):
        now = len(size)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        first.append(i)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[now] = q
            else:
                twin = len(size)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                first.append(first[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    best, i0, j0, at, n = 0, 0, 0, 0, 0
    for i, c in enumerate(x):
        while at and c not in step[at]:
            at = link[at]
            n = size[at]
        if c in step[at]:
            at, n = step[at][c], n + 1
        else:
            n = 0
        if n > best:
            best, i0, j0 = n, i - n + 1, first[at] - n + 1
    return best, i0, j0


def _blocks(a: str, b: str) -> int:
    """Characters in matching blocks: the longest common substring, then the same to its left and right."""
    total, todo = 0, [(a, b)]
    while todo:
        x, y = todo.pop()
        best, i, j = _longest(x, y) if x and y else (0, 0, 0)
        if best:
            total += best
            todo += [(x[:i], y[:j]), (x[i + best :], y[j + best :])]
    return total


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Twice the matching characters over all characters, from 0 to 1; 0 for null or empty."""
    for a, b in batches:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = x or "", y or ""
            out.append(round(200.0 * _blocks(x, y) / (len(x) + len(y))) / 100.0 if x and y else 0.0)
        yield pd.Series(out)


def code_similarity(prediction: Column, truth: Column) -> Column:
    """The ratio for the first line without a back-tick, number sign or double slash."""
    lines = F.filter(F.split(F.ltrim(prediction), "\n"), lambda x: ~x.contains("`") & ~x.contains("#") & ~x.contains("//"))
    return fuzzy_ratio(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), truth)


def classification(prediction: Column, truth: Column, classes: Column) -> Column:
    """Classes found in the prediction, less those that are proper parts of the truth: 1 / their number if the truth is one of them, else 0."""
    held = F.filter(classes, lambda c: prediction.contains(c))
    held = F.filter(held, lambda c: ~(truth.contains(c) & (c != truth)))
    return F.when(F.array_contains(held, truth), 1.0 / F.size(held)).otherwise(0.0)


def count_score(prediction: Column, truth: Column) -> Column:
    """Share of the prediction's digit runs that equal the truth; 0 without any."""
    runs = F.regexp_extract_all(prediction, F.lit(r"(\d+)"), F.lit(1))
    return F.when(F.size(runs) == 0, 0.0).otherwise(F.size(F.filter(runs, lambda x: x == truth)).cast("double") / F.size(runs))


def retrieval_score(prediction: Column, truth: Column) -> Column:
    """The same for the number in the truth's `Paragraph N`."""
    return count_score(prediction, F.regexp_extract(truth, r"Paragraph (\d+)", 1))


def match_all(prediction: Column, answers: Column) -> Column:
    """Share of answers that the prediction contains, in any case; 0 without answers."""
    found = F.filter(answers, lambda a: F.lower(prediction).contains(F.lower(a)))
    return F.when(F.size(answers) == 0, 0.0).otherwise(F.size(found).cast("double") / F.size(answers))


def match_part(prediction: Column, answers: Column) -> Column:
    """1 if any answer is contained in any case, else the best F1."""
    hit = F.exists(answers, lambda a: F.lower(prediction).contains(F.lower(a)))
    return F.when(hit, 1.0).otherwise(best(answers, lambda a: f1(prediction, a)))


def best(answers: Column, score) -> Column:
    """The largest score over the answers; 0 without any."""
    return F.coalesce(F.array_max(F.transform(answers, score)), F.lit(0.0))


def first_int(prediction: Column, label: Column) -> Column:
    """1 if the first run of digits equals the label."""
    return F.when(F.regexp_extract(prediction, r"(\d+)", 1) == label, 1.0).otherwise(0.0)


#: What str.split() takes for white space (fixed values).
WHITE = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: Characters that count as blanks for keys and for choices (fixed values).
KEY_MARKS, CHOICE_MARKS = "\n:\"'.,?!{}", "\n\"'.,?!{}"
#: Phrases that a choice stands behind, in the order in which they are looked for (fixed values).
PHRASES = ("answer is:", "answer:", "answer is", "option is")


def kv_score(prediction: Column, label: Column) -> Column:
    """1 if the label is a token, ten punctuation characters counting as blanks."""
    return F.when(F.array_contains(F.split(F.translate(prediction, KEY_MARKS, " " * len(KEY_MARKS)), WHITE), label), 1.0).otherwise(0.0)


def math_score(prediction: Column, label: Column) -> Column:
    """The first decimal or whole number equals the label: as numbers if the label has a point, else as whole numbers (a decimal number then fails)."""
    first = F.regexp_extract(prediction, r"(\d+\.\d+|\d+)", 1)
    number = F.when(label.contains("."), first.try_cast("double") == label.try_cast("double")).otherwise(first.try_cast("long") == label.try_cast("long"))
    whole = label.contains(".") | ~first.contains(".")
    return F.when((first != "") & whole & F.coalesce(number, F.lit(False)), 1.0).otherwise(0.0)


def choice_score(prediction: Column, label: Column) -> Column:
    """A first character from A to D decides. Else, in the text with nine punctuation characters as blanks, the first of the phrases that is there decides: one more
    character is passed over, and one of the label's must follow. Else the first token that lies within ABCD."""

    def score(text: Column) -> Column:
        head = F.substring(text, 1, 1)
        plain = F.regexp_replace(F.translate(text, CHOICE_MARKS, " " * len(CHOICE_MARKS)), " {2,}", " ")
        word = F.get(F.filter(F.split(plain, WHITE), lambda w: (w != "") & F.lit(LETTERS).contains(w)), F.lit(0))
        out = F.coalesce(word == label, F.lit(False))
        for phrase in reversed(PHRASES):
            at = F.locate(phrase, plain)
            then = F.substring(plain, at + len(phrase) + 1, F.lit(1))
            out = F.when(at > 0, (then != "") & label.contains(then)).otherwise(out)
        return F.when((head != "") & F.lit(LETTERS).contains(head), head == label).otherwise(out)

    return F.when(score(prediction), 1.0).otherwise(0.0)


def without_thought(text: Column) -> Column:
    """What follows the last </think>, without blanks before it."""
    return F.ltrim(F.element_at(F.split(text, "</think>"), -1))


def by_task(task: Column, prediction: Column, answers: Column, classes: Column | None = None) -> Column:
    """The scorer of the task, the largest over the answers."""
    out = F.when(task == "classification", best(answers, lambda a: classification(prediction, a, classes))) if classes is not None else F.when(F.lit(False), 0.0)
    out = out.when(task == "count", best(answers, lambda a: count_score(prediction, a))).when(task == "retrieval", best(answers, lambda a: retrieval_score(prediction, a)))
    return out.when(task == "match_all", match_all(prediction, answers)).when(task == "match_part", match_part(prediction, answers)).otherwise(best(answers, lambda a: f1(prediction, a)))


def middle_cut(tokens: Column, most: int) -> Column:
    """The first half and the last rest of a longer list."""
    head = most // 2
    tail = most - head
    return F.when(F.size(tokens) <= most, tokens).otherwise(F.concat(F.slice(tokens, 1, head), F.slice(tokens, F.size(tokens) - tail + 1, F.lit(tail))))
