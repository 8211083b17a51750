import re

import numpy as np
import pytest

from vexil.llm import common, minhash


def sets(rows, width):
    out = {}
    for r in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        out[r[0]] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    return out


def brute(rows, width, percent=80):
    held = sets(rows, width)
    root = {i: i for i in held}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(held)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = held[i], held[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(held[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_brute_force(docs, rows, width):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, width).collect()}
    want = brute(rows, width)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i][1]) for i, r in got.items())


def test_a_group_whose_members_link_in_a_chain(spark):
    """Each text is like its neighbours only, so heads alone can't join the group."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 6 : i * 6 + 100])) for i in range(40)]
    rows += [(100 + i, " ".join([*words[:80], *(f"e{i}x{j}" for j in range(14))])) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, 2).collect()}
    assert got == brute(rows, 2)


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c"), (3, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, 2).collect()), key=str)
    assert got == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)], key=str)


def test_keep_one_keeps_columns_and_least_ids(docs, rows):
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in brute(rows, 5).items() if i == c}


def test_empty(empty):
    assert minhash.near_duplicates(empty).count() == 0 and minhash.keep_one(empty).count() == 0


def test_word_hashes_do_not_depend_on_batch_or_segment(rows, monkeypatch):
    texts = [r[1] for r in rows]
    words, at = common.hash_words(texts)
    monkeypatch.setattr(common, "_SEGMENT", 64)
    again, at2 = common.hash_words(texts)
    assert (words == again).all() and (at == at2).all()
    for i, t in enumerate(texts):
        assert (common.hash_words([t])[0] == words[at[i] : at[i + 1]]).all()
        assert at[i + 1] - at[i] == len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_signatures_are_minima_and_maxima():
    x = np.arange(1, 50, dtype=np.uint64)
    sig = minhash.signatures([x, x[:3]])
    h = (x ^ minhash._XOR[4]) * minhash._MUL[4]
    assert sig[0, 4] == h.min() and sig[0, minhash.PERMS + 4] == h.max() and sig[1, 4] == h[:3].min()


def test_bits_bound_the_difference():
    rng = np.random.default_rng(2)
    for n, changed in ((40, 3), (400, 60), (900, 0)):
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[changed:], rng.integers(0, 2**63, changed, dtype=np.uint64)])
        a, b = minhash.odd_bits(common.mix64(x)), minhash.odd_bits(common.mix64(y))
        differ = sum(int(v).bit_count() for v in (a ^ b).view(np.uint64))
        assert differ <= 2 * changed and (changed == 0 or differ > 0)
