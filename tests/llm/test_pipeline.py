import re
from collections import Counter

import numpy as np

import corpus_pipeline
from vexil.llm import common, mixing, pieces


def test_stages_follow_on(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.stash(stage(spark, kept, str(tmp_path)), name)
        if name != "encoding":
            assert out.columns == docs.columns
        counts[name] = Counter(r["doc_id"] for r in out.collect())
        if name == "mixing":
            plan = {r["doc_id"]: r["copies"] for r in mixing.plan(kept).collect()}
            assert counts[name] == Counter({i: n for i, n in plan.items() if n})
        if name == "encoding":
            text = {r["doc_id"]: r["text"] for r in kept.collect()}
            vocabulary = pieces.Pieces(pieces.MODEL)
            for r in out.collect():
                assert r["lossless"] and vocabulary.decode(np.frombuffer(r["ids"], np.uint16)) == text[r["doc_id"]]
        kept = out
    assert set(counts["language_id"]) == set(counts["line_dedup"]) == {r[0] for r in rows if r[1] and re.search("[a-zA-Z]", r[1])}
    assert 72 not in counts["near_dedup"] and 79 not in counts["near_dedup"] and 60 in counts["near_dedup"]


def test_empty_table_and_repeated_rows(spark, docs, rows, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/e/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0
    some = docs.filter("doc_id in (3, 4, 74, 75)")
    some.union(some).coalesce(1).write.parquet(f"{tmp_path}/r/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/r").collect()
    plan = mixing.plan(some.filter("doc_id in (3, 4)")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter({r["doc_id"]: r["copies"] for r in plan if r["copies"]}) and all(r["lossless"] for r in got)
