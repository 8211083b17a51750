import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from vexil.llm import lm
from vexil.llm import materialise as mt
from vexil.llm.common import lower_str


@pytest.fixture(scope="module")
def model(rows):
    ids = [lm.ids_of(r[1], mt.RANKS) for r in rows]
    counts = np.bincount(np.concatenate(ids), minlength=mt.END + 1)
    slot = lm.slots_of(counts)
    pairs = np.zeros((lm.SLOTS + 2) * lm.SLOTS)
    for x in ids:
        s = slot[x]
        np.add.at(pairs, np.concatenate([[lm.START], s[:-1]]) * lm.SLOTS + s, 1)
    out = lm.Model.counted(slot, counts, pairs.reshape(lm.SLOTS + 2, lm.SLOTS))
    out.weights.w1[:] = np.random.default_rng(0).standard_normal(out.weights.w1.shape) * 0.1
    out.weights.w2[:] = np.random.default_rng(1).standard_normal(out.weights.w2.shape) * 0.1
    return out, ids


def test_windows_score_each_token_once():
    docs = [np.arange(n) for n in (1, 31, 32, 33, 100)]
    known, goal, of = lm.windows(docs)
    for i, d in enumerate(docs):
        mine = goal[of == i].ravel()
        assert mine[mine >= 0].tolist() == d.tolist()
    for k, g in zip(known, goal):
        for j in range(lm.STRIDE):
            if g[j] > 0:
                assert k[lm.CONTEXT + j] == g[j] - 1


def test_probabilities_sum_to_one(model):
    m, ids = model
    known, goal, _ = lm.windows([m.slot[ids[3]]])
    at = int((goal[0] >= 0).sum()) - 1
    total = 0.0
    for s in range(lm.SLOTS):
        g = goal.copy()
        g[0, at] = s
        total += math.exp(m.log_probs(known[:1], g[:1])[0, at])
    assert total == pytest.approx(1, abs=1e-3)
    assert np.bincount(m.slot, np.exp(m.inside), lm.SLOTS) == pytest.approx(np.ones(lm.SLOTS), abs=1e-3)


def test_attention_is_causal_and_skips_padding(model):
    m, ids = model
    known, goal, _ = lm.windows([m.slot[ids[4]][:20]])
    a = m.log_probs(known, goal)[0, :10]
    later = known.copy()
    later[0, lm.CONTEXT + 10 :] = 5
    assert np.allclose(m.log_probs(later, goal)[0, :10], a)


def naive_score(m, ids):
    """log10 probability of a list of ids, a token at a time: attention over what its window shows, then group, slot, and id in it."""
    w, slots, total = m.weights, m.slot[ids], 0.0
    known = [lm.START, *slots[:-1].tolist()]
    for t, (i, s) in enumerate(zip(ids.tolist(), slots.tolist(), strict=True)):
        first = max(0, t // lm.STRIDE * lm.STRIDE - lm.CONTEXT)
        seen = range(first, t + 1)
        at = [math.exp(float(w.q[known[t]] @ w.k[known[j]]) / lm.WIDTH**0.5 + float(w.far[t - j])) for j in seen]
        out = sum(a * w.v[known[j]].astype(float) for a, j in zip(at, seen, strict=True)) / sum(at)
        group, place = divmod(s, lm.GROUP)
        one = m.base1[known[t]].astype(float) + out @ w.w1
        two = m.base2[group][known[t]].astype(float) + out @ w.w2[group]
        total += one[group] - math.log(np.exp(one).sum()) + two[place] - math.log(np.exp(two).sum()) + float(m.inside[i])
    return total / math.log(10)


def test_scores_equal_a_forward_pass_a_token_at_a_time(model):
    m, ids = model
    some = [ids[75], ids[3], ids[60], ids[80][:300]]
    assert max(map(len, some)) > 3 * lm.STRIDE
    assert m.scores(some) == pytest.approx([naive_score(m, x) for x in some], rel=1e-4)


def test_null_and_repeated_ids_and_clashing_columns(spark):
    made = [(None, "a b c", 1.0, 2), (1, "a b", 1.0, 2), (1, "a b", 1.0, 2), (2, None, 1.0, 2)]
    got = lm.train_and_score(spark.createDataFrame(made, "doc_id long, text string, score double, row int").select("doc_id", "text")).collect()
    assert len(got) == 4 and all(math.isfinite(r["score"]) for r in got)
    assert [(r["held_out"], r["n_tokens"]) for r in got if r["doc_id"] is None] == [(False, 4)]


def test_gradient_equals_differences(model):
    m, ids = model
    known, goal, _ = lm.windows([m.slot[x] for x in ids[:3]])
    g, flat, n = m.gradient(known, goal), m.weights.flat(), (goal >= 0).sum()
    rng = np.random.default_rng(3)
    for i in [*rng.choice(np.flatnonzero(np.abs(g) > 1e-4), 12), len(flat) - 1]:
        e = np.zeros_like(flat)
        e[i] = 1e-2
        up, down = (lm.Model(m.slot, m.inside, m.base1, m.base2, lm.Weights.shaped(flat + s * e)).log_probs(known, goal).sum() for s in (1, -1))
        assert g[i] == pytest.approx(-(up - down) / 2e-2 / n, rel=0.05, abs=2e-6)


def test_attention_hands_on_what_its_gradient_needs(model):
    m, ids = model
    known, goal, _ = lm.windows([m.slot[x] for x in (ids[3], ids[4][:20])])
    asks, (q, k, v, p), total, seen = m.attend(known)
    w, there = m.weights, (known != lm.PAD)[..., None]
    assert np.allclose(q, w.q[asks] / lm.WIDTH**0.5) and np.array_equal(k, w.k[known])
    assert np.array_equal(v, np.concatenate([w.v[known] * there, there], 2))
    back = lm.CONTEXT + np.arange(lm.STRIDE)[:, None] - np.arange(lm.WINDOW)
    assert np.allclose(p, np.where(back >= 0, np.exp(np.einsum("wid,wjd->wij", q, k) + w.far[np.maximum(back, 0)]), 0), rtol=1e-4)
    assert np.allclose(total, p @ there, rtol=1e-4) and np.allclose(seen, (p @ v)[..., : lm.WIDTH] / total, atol=1e-4)


def test_padding_learns_nothing(model):
    m, ids = model
    known, goal, _ = lm.windows([m.slot[ids[4]][:20], m.slot[ids[3]]])
    assert (known == lm.PAD).any()
    g = lm.Weights.shaped(m.gradient(known, goal))
    assert not any(x[lm.PAD].any() for x in (g.q, g.k, g.v))
    assert all(x[lm.START].any() for x in (g.q, g.k, g.v))


def test_steps_are_those_of_adam(model):
    m, ids = model
    own, docs = lm.Model(m.slot, m.inside, m.base1, m.base2), [m.slot[x] for x in ids[60:73]] * 4
    known, goal, _ = lm.windows(docs)
    order = np.random.default_rng(0).permutation(len(known))
    steps = range(0, len(order), lm.BATCH)
    assert len(steps) > 1
    at, one, two = own.weights.flat().astype(float), 0.0, 0.0
    for t, i in enumerate(steps, 1):
        part = order[i : i + lm.BATCH]
        g = lm.Model(m.slot, m.inside, m.base1, m.base2, lm.Weights.shaped(at.astype(np.float32))).gradient(known[part], goal[part]).astype(float)
        one, two = 0.9 * one + 0.1 * g, 0.99 * two + 0.01 * g * g
        at -= lm.RATE * min(1, t / 20) * (1 - 0.9 * t / len(steps)) * one / (1 - 0.9**t) / (np.sqrt(two / (1 - 0.99**t)) + 1e-6)
        at = np.clip(at, -lm._BOUND, lm._BOUND)
    own.fit(docs, 0)
    assert np.allclose(own.weights.flat(), at, atol=2e-4)


def test_targets_of_a_group_are_one_slice(model):
    model, _ = model
    known, goal, _ = lm.windows([np.arange(5, 905, 3) % lm.SLOTS, np.array([7]), np.full(40, 3)])
    asks, _, _, seen = model.attend(known)
    real, group, place, mine, l1, l2, ends = model.grouped(asks, seen, goal)
    assert sorted(real) == np.flatnonzero(goal.ravel() >= 0).tolist()
    assert np.array_equal(group * lm.GROUP + place, goal.ravel()[real]) and (np.diff(group) >= 0).all()
    assert ends == [int((group < g).sum()) for g in range(lm.GROUPS + 1)]
    at = asks.ravel()[real]
    assert np.array_equal(mine, seen.reshape(-1, lm.WIDTH)[real])
    assert np.allclose(l1, model.base1[at] + mine @ model.weights.w1, atol=1e-4)
    assert np.allclose(l2, [model.base2[g, a] + m @ model.weights.w2[g] for g, a, m in zip(group, at, mine, strict=True)], rtol=1e-4)


def test_a_most_unlikely_target_has_a_finite_score(model):
    model, _ = model
    sure = lm.Model(model.slot, model.inside, model.base1.copy(), model.base2, model.weights)
    sure.base1[:, 3] = -200.0
    known, goal, _ = lm.windows([np.array([3 * lm.GROUP])])
    assert -300 < sure.log_probs(known, goal)[0, 0] < -150


def test_rows_are_summed_by_slot():
    rng = np.random.default_rng(2)
    rows, grad = rng.integers(0, 40, (6, 48)), rng.standard_normal((6, 48, 3 * lm.WIDTH)).astype(np.float32)
    want = np.zeros((lm.SLOTS + 2, 3 * lm.WIDTH))
    np.add.at(want, rows.ravel(), grad.reshape(-1, 3 * lm.WIDTH))
    assert np.allclose(lm._summed(rows, grad), want, atol=1e-5)


def test_training_lowers_the_loss(model):
    m, ids = model
    own = lm.Model(m.slot, m.inside, m.base1, m.base2)
    long = [m.slot[x] for x in ids[60:73]] * 3
    known, goal, _ = lm.windows(long)
    before = own.log_probs(known, goal).sum()
    own.fit(long, 0)
    assert own.log_probs(known, goal).sum() > before


def test_rows_against_brute_force(docs, rows):
    got = {r["doc_id"]: r for r in lm.train_and_score(docs).collect()}
    assert len(got) == len(rows)
    tokens = {r[0]: re.findall(r"[^\x20\x09-\x0D]+", lower_str(r[1] or "")) + [None] for r in rows}
    fold = {i: zlib.crc32(str(i).encode()) % 7 for i in tokens}
    c = Counter(w for i, t in tokens.items() if fold[i] != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        g = got[i]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (fold[i] == 2, len(t), sum(c[w] > 0 for w in t), n)
        assert g["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert g["score"] < 0


def test_every_training_document_shapes_the_slots_and_the_weights(docs, rows):
    learn = [lm.ids_of(r[1], mt.RANKS) for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    got = lm.train(lm.prepared(docs))
    assert got.fitted == sum(len(x) for x in learn)
    assert (got.model.slot == lm.slots_of(np.bincount(np.concatenate(learn), minlength=mt.END + 1))).all()


def test_a_task_fits_all_its_documents_in_bounded_chunks(model, monkeypatch):
    m, ids = model
    monkeypatch.setattr(lm, "_TOKENS", 50)
    batches = [pd.DataFrame({"ids": [x.astype("<u2").tobytes() for x in ids[i : i + 7]]}) for i in range(0, len(ids), 7)]
    chunks = list(lm._chunks(batches))
    assert [x.tolist() for c in chunks for x in c] == [x.tolist() for x in ids]
    assert len(chunks) > 1 and all(sum(len(x) for x in c[:-1]) < 50 for c in chunks)
    (sent,) = lm._trained(m, 0)(iter(batches))
    assert sent["n"].iloc[0] == sum(len(x) for x in ids)


def test_empty(empty):
    assert lm.train_and_score(empty).count() == 0
