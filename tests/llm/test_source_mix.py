"""Mixing: targets against the stated loop, copies near their targets, odd inputs."""

import pytest
from pyspark.sql import functions as F

from docengine.llm.source_mix import emit_copies, mix_sources, water_fill


def loop(sizes, weights, budget, most):
    """Share by weight, cap, and share the excess again until none is above."""
    total, capped = budget * sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= most * sizes[s]}
        if not over or not free:
            return share | {s: most * sizes[s] for s in capped}
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 50}, {"a": 1, "b": 1000, "c": 5, "d": 900, "e": 3}, {"a": 7}, {f"s{k:02}": (k * 37) % 90 + 1 for k in range(30)}])
def test_targets_follow_the_loop(spark, sizes):
    weights = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(sorted(sizes))}
    rows = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "source string, source_size long, weight double")
    got = {r["source"]: r["target"] for r in water_fill(rows, 1.5, 2.0).collect()}
    want = loop(sizes, weights, 1.5, 2.0)
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_copies(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 5 + 1).cast("int")).alias("text"), F.lit(1).alias("copies"))
    mixed = mix_sources(docs)
    assert mixed.columns.count("copies") == 1
    rows = mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    for r in rows:
        assert abs(r["taken"] - r["target"]) <= 0.1 * r["target"] + 1 and r["most"] <= 2
    again = {(r["doc_id"], r["copies"]) for r in mix_sources(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in mixed.collect()}
    assert emit_copies(mixed, ["doc_id"]).count() == sum(c for _, c in again)


def test_odd_inputs(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, None), (None, "", "x"), (3, "word", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(docs).collect()
    assert len(got) == 5 and all(r["target"] is not None and 0 <= r["copies"] <= 2 for r in got)
    assert mix_sources(docs.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, "", "x"), (2, None, "y")], "doc_id long, text string, source string")
    assert [(r["target"], r["copies"]) for r in mix_sources(empty).collect()] == [(0.0, 0), (0.0, 0)]
