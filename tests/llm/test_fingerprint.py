import hashlib
import re

from pyspark.sql import functions as F

from vexil.llm import fingerprint as fp


def paragraphs(text):
    out = []
    for line in text.split("\n"):
        out += re.split(r"(?<=[.!?]) ", line)
    return {x for x in out if x}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_every_row_against_brute_force(spark, docs, rows):
    got = {r["doc_id"]: r for r in fp.compare(docs).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for i, r in enumerate(order):
        text, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + nxt[:cut]
        g = got[r[0]]
        assert (g["n_chars"], g["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(g["near_edited"] - likeness(paragraphs(text), paragraphs(edited))) < 1e-12
        assert abs(g["near_next"] - likeness(paragraphs(text), paragraphs(nxt))) < 1e-12
    same = [r for r in got.values() if r["doc_id"] in (78, 79)]
    assert same[0]["fingerprint"] == same[1]["fingerprint"] != ""


def test_peeling_gives_the_digests_and_grows_when_it_fails(spark):
    a, b = list(range(1, 60)), list(range(50, 200))
    pairs = spark.createDataFrame([(1, "e", a, b), (2, "e", a, a), (3, "e", [], [7])], "row long, kind string, a array<long>, b array<long>")
    small = {r["row"]: r for r in fp.recovered(pairs, 30, 2).collect()}
    assert small[1]["left"] > 0 and small[2]["left"] == 0 and small[3]["only_b"] == [7]
    large = {r["row"]: r for r in fp.recovered(pairs, 600, 2).collect()}
    assert large[1]["left"] == 0 and large[1]["only_a"] == list(range(1, 50)) and large[1]["only_b"] == list(range(60, 200))
    counts = {r["row"]: (r["only_a"], r["only_b"]) for r in fp.differences(pairs, 2).collect()}
    assert counts == {1: (49, 140), 2: (0, 0), 3: (0, 1)}


def test_next_row_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_A_BUCKET", 3)
    ids = [i * i % 211 for i in range(40)] + [None, None]
    df = spark.createDataFrame([(i, f"t{n:02d}") for n, i in enumerate(ids)], "doc_id long, text string").withColumn("items", F.array(F.lit(1).cast("long")))
    got = {(r["doc_id"], r["text"]): r["next_text"] for r in fp.with_next(df).collect()}
    order = sorted(((i, f"t{n:02d}") for n, i in enumerate(ids)), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert len(got) == len(ids)
    for at, r in enumerate(order):
        assert got[r] == order[(at + 1) % len(order)][1]


def test_null_and_repeated_ids_and_long_lines(spark):
    """A line of any length is cut after its sentences, so one character more changes one digest only."""
    line = "A first sentence. " * 40 + "The end"
    made = [(1, line), (2, line + "s"), (2, line + "s"), (None, "x. y"), (None, None), (3, "z" * 100_000)]
    df = spark.createDataFrame([(*r, "clash") for r in made], "doc_id long, text string, items string")
    got = fp.compare(df).collect()
    assert len(got) == len(made) and all(0 <= r["near_next"] <= 1 for r in got)
    by = {(r["doc_id"], r["n_chars"]): r for r in got}
    assert by[2, len(line) + 1]["n_items"] == by[1, len(line)]["n_items"] == 2 and by[None, 0]["fingerprint"] == "" and by[None, 4]["n_items"] == 2


def test_empty(empty):
    assert fp.compare(empty).count() == 0
