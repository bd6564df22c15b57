"""Temperature mixing: targets, budgets and realised copies."""

import math

import pytest
from pyspark.sql import functions as F

from labelscope.llm import mixing as M


def docs(spark, sizes):
    rows, i = [], 0
    for source, n in sizes.items():
        for k in range(n):
            rows.append((i, " ".join(["w"] * (5 + (i * 7) % 40)), source))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


SIZES = {"big": 900, "mid": 200, "small": 60, None: 30}


@pytest.mark.parametrize("limit", [1.0, 1.5, 4.0])
def test_repetition_limit(spark, limit):
    df = docs(spark, SIZES)
    mix = M.temperature_mix(df, max_repetition=limit)
    rows = mix.copies(df.withColumn("t", M.word_count(F.col("text"))), "source", "doc_id")
    by = {r["source"]: r for r in rows.groupBy("source").agg(
        F.sum("t").alias("t"), F.sum(F.col("t") * F.col("n_copies")).alias("read"), F.min("n_copies").alias("least"), F.max("n_copies").alias("most")).collect()}
    assert all(r["least"] >= 1 for r in by.values())  # nothing is lost
    assert all(r["read"] <= limit * r["t"] + 1 for r in by.values())
    assert max(r["read"] / r["t"] for r in by.values()) > limit - 0.1  # and the limit is used
    weights = {r["s"]: r for r in mix.weights.collect()}
    assert abs(sum(r["weight"] for r in weights.values()) - 1) < 1e-9
    for r in weights.values():  # quotas are met up to one document
        read = by[r["s"][1:] if r["s"] != "0" else None]["read"]
        assert r["quota"] - 45 < read <= r["quota"]


def test_entropy_target(spark):
    df = docs(spark, SIZES)
    mix = M.temperature_mix(df, min_entropy=1.2)
    w = [r["weight"] for r in mix.weights.collect()]
    h = -sum(x * math.log(x) for x in w)
    assert 1.2 <= h < 1.2001 and 0 < mix.exponent < 1
    assert M.temperature_mix(df, min_entropy=0.1).exponent == 1.0
    with pytest.raises(ValueError):
        M.temperature_mix(df)


def test_budget_and_realised_rows(spark):
    df = docs(spark, SIZES)
    total = df.agg(F.sum(M.word_count(F.col("text")))).first()[0]
    mix = M.temperature_mix(df, min_entropy=1.0, budget_tokens=total // 2)
    out = M.realise(df, mix)
    assert out.columns == df.columns
    read = out.agg(F.sum(M.word_count(F.col("text")))).first()[0]
    assert total // 2 - 4 * 45 <= read <= total // 2 + 4
    again = M.realise(df.repartition(7), M.temperature_mix(df.repartition(3), min_entropy=1.0, budget_tokens=total // 2))
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in again.collect())
    other = M.realise(df, M.temperature_mix(df, min_entropy=1.0, budget_tokens=total // 2, seed=7))
    assert sorted(r["doc_id"] for r in out.collect()) != sorted(r["doc_id"] for r in other.collect())


def test_shuffled_plan_gives_the_same(spark, monkeypatch):
    df = docs(spark, SIZES)
    one = sorted((r["doc_id"], r["n_copies"]) for r in M.temperature_mix(df, max_repetition=2.5).copies(df, "source", "doc_id").collect())
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    two = sorted((r["doc_id"], r["n_copies"]) for r in M.temperature_mix(df, max_repetition=2.5).copies(df, "source", "doc_id").collect())
    assert one == two


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x y", None), (None, "z", "a"), (4, "long " * 90_000, "c"), (4, "long", "c"), (5, "q", "0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_copies", F.lit("clash"))
    mix = M.temperature_mix(df, max_repetition=3.0)
    got = mix.copies(df, "source", "doc_id").collect()
    assert len(got) == len(rows) and all(r["n_copies"] >= 1 for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.realise(empty, M.temperature_mix(empty, max_repetition=2.0)).count() == 0


def test_no_python_runs(spark):
    df = docs(spark, {"a": 5, "b": 2})
    plan = M.realise(df, M.temperature_mix(df, max_repetition=2.0))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
