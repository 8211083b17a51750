import numpy as np
import pytest
import sentencepiece

from vexil.llm import pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(pieces.MODEL)


HARD = ["", " ", "  two  blanks ", "▁", "a▁b ▁ c", "\x00 nul\x00", "line\nline\n\n x", "日本語 と 中国", "é" * 200, "x" * 5000, "tab\tx", "🙂 <s> </s> <0x41>", "字" * 3000]


def test_without_dropout_it_is_the_library(vocabulary, rows):
    enc, sp = pieces.Encoder(vocabulary, 0.0), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for text in [r[1] for r in rows if r[1]]:
        assert enc.encode(text).tolist() == sp.encode(text)


def test_dropout_varies_reruns_and_decodes(vocabulary, rows):
    enc, again = pieces.Encoder(vocabulary, 0.3), pieces.Encoder(vocabulary, 0.3)
    differ = 0
    for text in [*HARD, *(r[1] for r in rows if r[1] is not None)]:
        a, b = enc.encode(text, 0), enc.encode(text, 1)
        assert vocabulary.decode(a) == text == vocabulary.decode(b)
        assert (a == again.encode(text, 0)).all()
        differ += len(a) != len(b) or bool((a != b).any())
    assert differ > 20


def test_rate_one_leaves_single_characters(vocabulary):
    assert pieces.Encoder(vocabulary, 1.0).encode("the").tolist() == [vocabulary.ids[c] for c in "▁the"]


def test_every_occurrence_and_copy_is_cut_anew(spark, vocabulary):
    enc = pieces.Encoder(vocabulary)
    text = " ".join(["international"] * 400)
    cuts = set()
    for doc in range(5):
        got, start = vocabulary.spelled.take(enc.encode(text, enc.variant(doc))), 0
        for i in range(1, len(got) + 1):
            if i == len(got) or got[i].startswith(b" "):
                cuts.add(tuple(got[start:i]))
                start = i
    assert len(cuts) > 5
    copies = spark.createDataFrame([(7, text)] * 3, "doc_id long, text string").coalesce(1)
    assert len({bytes(r["ids"]) for r in pieces.encode(copies, ["doc_id"]).collect()}) == 3


def naive(vocabulary, word, key, rate):
    """Merge-dropout spelled out: look for the best pair that wasn't skipped, draw, merge or skip, until none is left."""
    parts, skipped, met = [(c, i) for i, c in enumerate(word)], set(), 0
    while True:
        open_ = [(vocabulary.rank[x + y], i, j) for (x, i), (y, j) in zip(parts, parts[1:]) if x + y in vocabulary.rank and (x, i, y, j) not in skipped]
        if not open_:
            break
        _, i, j = min(open_)
        at = next(n for n, p in enumerate(parts) if p[1] == i)
        (x, _), (y, _) = parts[at : at + 2]
        if int(pieces.draws(np.array([key], np.uint64), met)[0]) < rate * 2**53:
            skipped.add((x, i, y, j))
        else:
            parts[at : at + 2] = [(x + y, i)]
        met += 1
    out = []
    for x, _ in parts:
        out += [vocabulary.ids[x]] if x in vocabulary.ids else [vocabulary.bytes[b] for b in x.encode()]
    return out


@pytest.mark.parametrize("rate", [0.1, 0.4])
def test_every_occurrence_equals_the_agenda_spelled_out(vocabulary, rows, rate):
    enc = pieces.Encoder(vocabulary, rate)
    texts = ["", " ", "  two  blanks ", "a▁b ▁ c", "line\nline\n\n x", "日本語 と 中国 🙂", "x" * 60, *(r[1][:500] for r in rows if r[1])]
    keys = [enc.variant(i, i % 3) for i in range(len(texts))]
    for text, key, got in zip(texts, keys, enc.encode_many(texts, keys), strict=True):
        units = [u for u in enc.units(" " + text) if u]
        own = pieces.mix64(np.arange(len(units), dtype=np.uint64) * np.uint64(pieces._PLACE) + np.uint64(key))
        want = []
        for u, k in zip(units, own.tolist(), strict=True):
            want += [vocabulary.bytes[b] for b in "▁".encode()] if u == pieces._LITERAL else naive(vocabulary, u, k, rate)
        assert got.tolist() == want


def test_group_and_block_sizes_change_nothing(vocabulary, rows, monkeypatch):
    texts = [r[1] for r in rows if r[1]]
    want = [pieces.Encoder(vocabulary).encode(t, 5) for t in texts]
    monkeypatch.setattr(pieces, "_GROUP", 50)
    monkeypatch.setattr(pieces, "_BLOCK", 7)
    enc = pieces.Encoder(vocabulary)
    assert all((a == b).all() for a, b in zip(want, enc.encode_many(texts, [5] * len(texts)), strict=True))


def test_null_and_repeated_ids_and_clashing_columns(spark):
    text = "some international words " * 20
    made = [(None, text, 1, 2), (None, None, 3, 4), (4, text, 5, 6), (4, text, 5, 6), (5, "", 7, 8)]
    docs = spark.createDataFrame(made, "doc_id long, text string, n_tokens int, ids int").coalesce(1)
    got = pieces.encode(docs, ["doc_id"]).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 0, 4, 4, 5] and all(r["lossless"] for r in got)
    assert sorted(r["n_tokens"] for r in got)[:2] == [0, 1]


def test_operator(docs, rows, empty):
    got = {r["doc_id"]: r for r in pieces.encode(docs, ["doc_id", "score", "rank"]).collect()}
    assert len(got) == len(rows) and all(r["lossless"] for r in got.values())
    assert got[74]["n_tokens"] == 0 and got[75]["n_tokens"] == 1 and got[5]["score"] == 0.5
    enc = pieces.Encoder(pieces.Pieces(pieces.MODEL))
    assert np.frombuffer(got[3]["ids"], np.uint16).tolist() == enc.encode(rows[3][1], enc.variant("3")).tolist()
    assert pieces.encode(empty, ["doc_id"]).count() == 0
