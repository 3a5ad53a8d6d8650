import re

import pytest

from cadenza.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        spare = total - sum(most * sizes[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and spare * weight[s] / share > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in capped else spare * weight[s] / share for s in order}
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 3, None: 50, "": 0}, {"z": 5}, {f"s{i}": (i * 7919) % 97 for i in range(40)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_plan_and_documents(spark):
    rows = [(i, "w " * (i % 13), ["a", "b", None][i % 3], 1) for i in range(600)] + [(None, "x y", "a", 2), (None, None, "b", 3), (7, "w " * 7, "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target long")
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(rows)
    assert all(r.taken == r.size * r.copies and 0 <= r.copies <= 3 for r in plan)
    assert sorted(map(str, plan)) == sorted(map(str, mixing.mix_plan(docs).collect()))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(re.findall(mixing.WORD, r.text or "")) for r in mixed.collect()) == sum(r.taken for r in plan)
    assert mixing.mix_plan(docs.limit(0)).count() == 0 and mixing.mix_documents(docs.limit(0)).count() == 0


def test_taken_comes_near_the_target(spark):
    plan = mixing.mix_plan(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").drop("source").withColumn("source", mixing.F.lit("s")))
    total = plan.agg(mixing.F.sum("taken"), mixing.F.max("target")).first()
    assert abs(total[0] / total[1] - 1) < 0.05
