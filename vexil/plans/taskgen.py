"""Synthetic tasks: needles in filler, word counting, windows, grids; all of it seeded by the sample's id, so reruns agree."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The filler sentences (fixed value).
FILLER = "The grass is green. The sky is blue. The sun is yellow. Here we go. There and back again."
KINDS = ("single", "multi_key", "multi_query", "multi_value", "chain", "common_words", "frequent_words", "passkey", "qa")
#: Places that a question is about (any will do).
CITIES = ("Quito", "Turku", "Kobe", "Split", "Accra", "Hobart")


def scatter(rng: np.random.Generator, needles: list[str], words: int) -> str:
    """Filler of about so many words with the needles, in order, at sorted random sentence ends."""
    sentences = [s.strip() + "." for s in FILLER.split(".") if s.strip()]
    hay = list(itertools.islice(itertools.cycle(sentences), max(len(needles), words // 4)))
    depths = np.sort(rng.choice(len(hay) + 1, len(needles), replace=len(needles) > len(hay)))
    for d, n in zip(depths[::-1].tolist(), needles[::-1], strict=True):
        hay.insert(d, n)
    return " ".join(hay)


def _name(rng: np.random.Generator) -> str:
    return "".join(rng.choice(list("bdfgklmnprstv")) + rng.choice(list("aeiou")) for _ in range(4))


def sample(kind: str, sample_id: int, words: int, seed: int = 0) -> tuple[str, list[str], dict[str, str]]:
    """(prompt, answers, facts about the sample)."""
    rng = np.random.default_rng([seed, KINDS.index(kind), sample_id])
    number = lambda: str(rng.integers(1_000_000, 10_000_000))
    say = lambda k, v: f"The special number for {k} is {v}."
    if kind in ("single", "multi_key", "multi_query", "multi_value"):
        keys = [_name(rng) for _ in range(1 if kind in ("single", "multi_value") else 4)]
        pairs = [(k, number()) for k in keys for _ in range(4 if kind == "multi_value" else 1)]
        asked = keys if kind == "multi_query" else keys[:1]
        prompt = scatter(rng, [say(k, v) for k, v in pairs], words) + f" What are the special numbers for {', '.join(asked)}?"
        return prompt, [v for k, v in pairs if k in asked], {"needles": str(len(pairs))}
    if kind == "chain":
        names = [_name(rng).upper() for _ in range(5)]
        value = number()
        facts = [f"VAR {names[0]} = {value}."] + [f"VAR {b} = VAR {a}." for a, b in itertools.pairwise(names)]
        return scatter(rng, facts, words) + f" Which variables have the value {value}?", names, {"hops": "4"}
    if kind == "common_words":
        pool = list(dict.fromkeys(_name(rng) for _ in range(max(20, words // 6))))
        often, rare = pool[:10], pool[10:]
        bag = often * 30 + rare * 3
        rng.shuffle(bag)
        return "Words: " + " ".join(bag) + " Which ten words are most common?", often, {"words": str(len(bag))}
    if kind == "frequent_words":
        pool = list(dict.fromkeys(_name(rng) for _ in range(50)))
        ranks = np.minimum(rng.zipf(2.0, max(60, words)), len(pool)) - 1
        bag = [pool[r] for r in ranks]
        n = pd.Series(bag).value_counts(sort=False).reset_index()
        n.columns = ["word", "n"]
        best = n.sort_values(["n", "word"], ascending=[False, True])["word"].tolist()[1:4]
        return "Text: " + " ".join(bag) + " Which words are second to fourth most frequent?", best, {"words": str(len(bag))}
    if kind == "qa":
        city, year = rng.choice(CITIES), str(rng.integers(1400, 1901))
        return scatter(rng, [f"{city} was founded in the year {year}."], words) + f" In what year was {city} founded?", [year], {"needles": "1"}
    key = str(rng.integers(10_000, 100_000))
    return passkey(words, 0.5, key), [key], {"depth": "0.5"}


def passkey(words: int, depth: float, key: str) -> str:
    """Exactly so many words, the needle's sentence beginning at the sentence end nearest below depth."""
    needle = f"The pass key is {key}. Remember it.".split()
    hay = list(itertools.islice(itertools.cycle(FILLER.split()), words - len(needle)))
    at = int(depth * len(hay))
    while at > 0 and not hay[at - 1].endswith("."):
        at -= 1
    return " ".join(hay[:at] + needle + hay[at:])


def passkey_prompt(words: int, depth: float, key: Column) -> Column:
    """passkey() of a column of keys: the filler and the place are the same for all."""
    head, tail = passkey(words, depth, "\x00").split("\x00")
    return F.concat(F.lit(head), key, F.lit(tail))


def samples(ids: DataFrame, kind: str, words: int, seed: int = 0) -> DataFrame:
    """(_id, task, prompt, answers, gen_meta) for ids(id)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f"{kind}-{i}", kind, *sample(kind, int(i), words, seed)) for i in pdf["id"]]
            yield pd.DataFrame(rows, columns=["_id", "task", "prompt", "answers", "gen_meta"])

    return ids.select("id").mapInPandas(run, "_id string, task string, prompt string, answers array<string>, gen_meta map<string,string>")


def largest_that_fits(size: Callable[[int], int], budget: int, low: int = 1, high: int = 1 << 20) -> int:
    """The largest argument whose size is within the budget, by halving; low if none is."""
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if size(mid) <= budget else (low, mid - 1)
    return low


def largest_fit(size: Callable[[Column], Column], budget: Column, low: int, high: int) -> Column:
    """largest_that_fits() of a column of budgets, by halving: as many steps as the range has bits, none of them a look at the rows."""
    start = F.struct(F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high"))

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at["low"] + at["high"] + 1) / 2)
        fits = size(mid) <= budget
        return F.when(at["low"] >= at["high"], at).otherwise(F.struct(F.when(fits, mid).otherwise(at["low"]).alias("low"), F.when(fits, at["high"]).otherwise(mid - 1).alias("high")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, (high - low).bit_length()))), start, halve)["low"]


def filled(tokens: Column, size: int) -> Column:
    """The list repeated and cut to exactly `size`."""
    times = F.ceil(F.lit(float(size)) / F.greatest(F.lit(1), F.size(tokens))).cast("int")
    return F.slice(F.flatten(F.array_repeat(tokens, times)), 1, size)


def windows(rows: DataFrame, tokens: str, offsets: list[int], size: int) -> DataFrame:
    """(..., start, window): a row a window; one that reaches beyond the tokens fails."""
    at = rows.withColumn("start", F.explode(F.array(*map(F.lit, offsets))))
    fits = F.when(F.col("start") + size <= F.size(tokens), F.slice(F.col(tokens), F.col("start") + 1, F.lit(size)))
    return at.withColumn("window", fits.otherwise(F.raise_error(F.lit("a window reaches beyond the tokens")).cast("array<string>")))


def grid(choices: dict[str, list] | str) -> list[dict]:
    """All combinations, or the list that a JSON text holds; each with a name made of its values."""
    made = json.loads(choices) if isinstance(choices, str) else [dict(zip(choices, x, strict=True)) for x in itertools.product(*choices.values())]
    return [c | {"name": "-".join(f"{k}{v}" for k, v in c.items())} for c in made]


TEMPLATES = {
    "passkey": "There is a pass key hidden in this text. Find it.\n\n{context}\n\n{input}",
    "number": "There is a sequence of digits hidden in this text. Find it.\n\n{context}\n\n{input}",
    "choice": "Read the book and answer the question.\n\n{context}\n\nQuestion: {input}\nA. {a}\nB. {b}\nC. {c}\nD. {d}\n\nThe letter of the right answer is",
    "qa": "Read the book and answer the question, be brief.\n\n{context}\n\nQuestion: {input}\nAnswer:",
    "kv": "Extract the value of the given key from this JSON.\n\n{context}\n\n{input}",
    "math": "Find what is asked for in the list.\n\n{context}\n\n{input}",
}


def prompt(kind: str, **parts: Column) -> Column:
    """The template with its parts filled in."""
    pieces: list[Column] = []
    rest = TEMPLATES[kind]
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        pieces += [F.lit(head), F.coalesce(parts[name], F.lit(""))]
    return F.concat(*pieces, F.lit(rest))


def letter(options: Column, answer: Column) -> Column:
    """A to D for the answer's place among the options; null if it isn't one."""
    at = F.array_position(options, answer)
    return F.when(at > 0, F.substring(F.lit("ABCD"), at.cast("int"), F.lit(1)))
