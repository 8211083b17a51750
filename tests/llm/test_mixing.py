import re

import pytest

from vexil.llm import mixing


def resharing(sizes, weights, share, most):
    """Targets by the words of the definition: reshare what is above a cap until nothing is."""
    total, capped = share * sum(sizes), [False] * len(sizes)
    while True:
        left = total - sum(most * s for s, c in zip(sizes, capped) if c)
        weight = sum(w for w, c in zip(weights, capped) if not c)
        target = [most * s if c else left * w / weight for s, w, c in zip(sizes, weights, capped)]
        new = [c or t > most * s for c, t, s in zip(capped, target, sizes)]
        if new == capped:
            return target
        capped = new


@pytest.mark.parametrize("sizes", [[10, 1000, 3, 70], [5], [0, 9, 9, 9, 1], [100] * 7, [1, 2, 4, 8, 16, 3000]])
def test_targets_equal_resharing(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = [r["target"] for r in mixing.targets(df).orderBy("source").collect()]
    want = resharing(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 1.5, 2.0)
    assert got == pytest.approx(want) and sum(got) == pytest.approx(1.5 * sum(sizes))


def test_plan_and_mix(docs, rows):
    plan = {r["doc_id"]: r for r in mixing.plan(docs).collect()}
    assert len(plan) == len(rows)
    for r in rows:
        p = plan[r[0]]
        rate = p["target"] / p["source_size"]
        assert p["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) and p["copies"] in (int(rate), int(rate) + 1) and p["copies"] <= 2
    again = {r["doc_id"]: r["copies"] for r in mixing.plan(docs.repartition(7)).collect()}
    assert again == {i: p["copies"] for i, p in plan.items()}
    mixed = mixing.mix(docs, number=None)
    assert mixed.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: p["copies"] for i, p in plan.items() if p["copies"]}


def test_taken_comes_near_the_target(spark):
    df = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 50 as int)) as text", "concat('s', id % 5) as source")
    for r in mixing.plan(df).selectExpr("source", "size * copies as taken", "target").groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] / r["max(target)"] - 1) < 0.06


def test_null_and_repeated_ids_and_clashing_columns(spark):
    made = [(None, "a b", None, 1, 2), (None, "a b", None, 1, 2), (3, "c", "s", 1, 2), (3, "c", "s", 1, 2), (4, None, "s", 1, 2)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string, copies int, target int")
    plan = mixing.plan(df).collect()
    assert len(plan) == 5 and len({r["copies"] for r in plan if r["doc_id"] == 3}) == 1 and [r["size"] for r in plan if r["doc_id"] == 4] == [0]
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "copy_no"] and {(r["copies"], r["target"]) for r in mixed.collect()} == {(1, 2)}


def test_empty(empty):
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
