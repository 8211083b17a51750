import zlib
from collections import Counter

import numpy as np

from vexil.llm import langid


def brute_grams(text):
    c = "".join(x if x.isalpha() else " " for x in text.lower())
    c = " " + " ".join(c.split()) + " "
    c = " " if not c.strip() else c
    n = Counter(x for x in c if x != " ")
    for k in (2, 3):
        n.update(c[i : i + k] for i in range(len(c) - k + 1))
    return n


def test_grams(rows):
    for r in rows[:40] + rows[72:]:
        if not r[1] or not any(x.isalpha() for x in r[1]):
            continue
        keys, counts = langid.grams(r[1])
        text = {"".join(map(chr, [k & 0x1FFFFF] if k < 1 << 21 else [k >> 21, k & 0x1FFFFF] if k < 1 << 42 else [k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF])): n for k, n in zip(keys.tolist(), counts.tolist())}
        assert text == dict(brute_grams(r[1]))


def test_long_texts_are_counted_in_steps(monkeypatch, rows):
    whole = langid.grams(rows[80][1])
    monkeypatch.setattr(langid, "_STEP", 500)
    parts = langid.grams(rows[80][1])
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_identify(docs, rows):
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g = got[r[0]]
        assert g["held_out"] == (zlib.crc32(str(r[0]).encode()) % 4 == 2) and 0 <= g["score"] <= 1
        if not r[1] or not any(c.isalpha() for c in r[1]):
            assert (g["lang_pred"], g["score"]) == ("und", 0.0)
    plain = [r for r in rows[:60] if len(r[1]) > 100]
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in plain]) == 1.0


def test_profile_against_brute_force(spark):
    df = spark.createDataFrame([("abab ab", "x"), ("b b a", "x"), (None, "x"), ("q", None)], "text string, lang string")
    n = brute_grams("abab ab") + brute_grams("b b a")
    key = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    want = [key(g) for g, _ in sorted(n.items(), key=lambda e: (-e[1], key(e[0])))]
    got = [r["gram"] for r in langid.train(df).orderBy("rank").collect()]
    assert got == want


def brute_judge(profiles, text):
    """Out-of-place distance spelled out: places of the text's most frequent n-grams against each profile; an n-gram that a profile lacks is as far as can be."""
    n = brute_grams(text)
    key = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    best = sorted(n, key=lambda g: (-n[g], key(g)))[: langid.TEXT_RANKS]
    off = {}
    for lang, ranked in profiles.items():
        off[lang] = sum(min(langid.RANKS, abs(ranked[key(g)] - i)) if key(g) in ranked else langid.RANKS for i, g in enumerate(best))
    lang = min(sorted(off), key=off.get)
    return lang, 1 - off[lang] / (langid.RANKS * len(best))


def test_distance_and_score_against_brute_force(docs, rows):
    profiles = [tuple(r) for r in langid.train(docs).select("lang", "rank", "gram").collect()]
    held = langid.Profiles(profiles)
    ranked = {}
    for lang, rank, gram in profiles:
        ranked.setdefault(lang, {})[gram] = rank
    for r in rows[:82]:
        if r[1] and any(c.isalpha() for c in r[1]):
            want, got = brute_judge(ranked, r[1][:4000]), held.judge(r[1][:4000])
            assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-12


def test_clashing_names_null_and_repeated_ids(spark):
    made = [(None, "der die das und", "de", 1, 2), (3, "the and of", "en", 1, 2), (3, "the and of", "en", 1, 2), (4, None, None, 1, 2)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, score int, lang_pred int")
    out = langid.predict(df, langid.train(df))
    assert out.columns == [*df.columns, "lang_pred_2", "score_2"]
    assert sorted((str(r["doc_id"]), r["lang_pred"], r["lang_pred_2"]) for r in out.collect()) == [("3", 2, "en"), ("3", 2, "en"), ("4", 2, "und"), ("None", 2, "de")]
    got = langid.identify(df).collect()
    assert len(got) == 4 and not any(r["held_out"] for r in got if r["doc_id"] is None)


def test_stage_keeps_columns_and_clean_rows(docs, rows):
    out = langid.keep_identified(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} >= {r[0] for r in rows[:73]}
    assert not {r["doc_id"] for r in out.collect()} & {74, 75, 76, 77}


def test_empty(empty):
    assert langid.identify(empty).count() == 0 and langid.keep_identified(empty).count() == 0
