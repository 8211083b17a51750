"""Small tables with what is hard: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, rank int"
SYLLABLES = {"en": ["the", "on", "er", "th", "ing", "ly", "re"], "de": ["ein", "sch", "ung", "ch", "ver", "zu", "ö"], "fr": ["eau", "que", "tion", "é", "ou", "le", "ç"]}


def prose(rng: random.Random, lang: str, words: int) -> str:
    out = []
    for i in range(words):
        out.append("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))))
        if i % 9 == 8:
            out[-1] += rng.choice([".", ".\n", ","])
    return " ".join(out).replace("\n ", "\n")


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text), 0.5, 1, 2)


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(60):
        lang = ["en", "de", "fr"][i % 3]
        out.append(doc(i, prose(rng, lang, rng.randint(1, 150)), lang, ["a", "a", "b", "c", None][i % 5]))
    base = prose(rng, "en", 120)
    for i in range(60, 72):
        words = base.split(" ")
        for _ in range((i - 60) // 2):
            words[rng.randrange(len(words))] = f"edit{i}x{rng.random()}"
        out.append(doc(i, " ".join(words)))
    out += [doc(72, base), doc(73, base.upper()), doc(74, None, "en"), doc(75, ""), doc(76, " \t\n "), doc(77, "!!! 123"), doc(78, "one"), doc(79, "one"), doc(80, prose(rng, "en", 6000)), doc(81, "x" * 30000)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
