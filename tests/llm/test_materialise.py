import numpy as np
import pytest

from vexil.llm import materialise as mt


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    p = mt.Permutation(n, 9)
    slots = p.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and (p.index(slots) == np.arange(n)).all()
    if n > 50:
        assert (slots != np.arange(n)).mean() > 0.9 and (slots != mt.Permutation(n, 10).slot(np.arange(n))).any()


def test_shards_hold_every_sequence_once(spark, docs, rows, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/docs")
    table = spark.read.parquet(f"{tmp_path}/docs")
    got = mt.materialise(table, f"{tmp_path}/out", length=64, span=50).collect()
    vocabulary = mt.tokens(mt.RANKS)
    want = {}
    for r in rows:
        ids = vocabulary.encode(r[1] or "")
        for part, at in enumerate(range(0, len(ids), 128)):
            want[r[0], part] = np.frombuffer(ids[at : at + 128], np.uint16).tolist()
    assert sorted(r["slot"] for r in got) == list(range(len(want)))
    stored = list(mt.read_slots(f"{tmp_path}/out", 0, len(got), 64))
    for r in got:
        ids = want[r["doc_id"], r["part"]]
        assert r["n_tokens"] == len(ids) and stored[r["slot"]].tolist() == ids + [mt.END] * (64 - len(ids))
    order = sorted(got, key=lambda r: r["slot"])
    assert [r["shard"] for r in order] == sorted(r["shard"] for r in got)
    assert all(b["byte_offset"] == (a["byte_offset"] + 128 if a["shard"] == b["shard"] else 0) for a, b in zip(order, order[1:]))
    resumed = list(mt.read_slots(f"{tmp_path}/out", 77, 130, 64))
    assert all((a == b).all() for a, b in zip(resumed, stored[77:130]))
    again = mt.materialise(table, f"{tmp_path}/out", length=64, span=50).collect()
    assert {(r["slot"], r["crc"]) for r in again} == {(r["slot"], r["crc"]) for r in got}


def test_null_and_repeated_ids(spark, tmp_path):
    made = [(None, "a b c " * 200), (1, "x"), (1, "x"), (None, None), (2, "")]
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    got = mt.materialise(spark.read.parquet(f"{tmp_path}/docs"), f"{tmp_path}/out", length=64, span=4).collect()
    vocabulary = mt.tokens(mt.RANKS)
    assert sorted(r["slot"] for r in got) == list(range(len(got))) and len(got) == sum(-(-len(vocabulary.encode(t or "")) // 128) for _, t in made)
    assert [r["n_tokens"] for r in got if r["doc_id"] == 2] == [1] and sum(r["doc_id"] == 1 for r in got) == 2


def test_empty(spark, empty):
    assert mt.materialise(empty.select("doc_id", "text")).count() == 0
