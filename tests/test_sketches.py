"""Stored sketches against exact profiles."""

import random

from pyspark.sql import functions as F

from labelscope.operators import sketches as S


def corpus(spark, n, values, seed=1):
    rng = random.Random(seed)
    rows = [(f"day{i % 5}", f"g{int(rng.paretovariate(1)) % values}" if i % 17 else None, "x" * rng.randrange(0, 300)) for i in range(n)]
    return spark.createDataFrame(rows, "day string, generator string, code string").repartition(4)


def exact_quantiles(lengths, ps=(0.25, 0.5, 0.75)):
    lengths = sorted(lengths)
    return [lengths[max(-(-int(p * 1000) * len(lengths) // 1000) - 1, 0)] for p in ps]


def test_small_corpora_are_exact(spark, tmp_path):
    df = corpus(spark, 2000, 50)
    path = str(tmp_path / "sketches")
    for d in range(5):  # a day at a time
        S.add_parts(S.sketch_parts(df.where(F.col("day") == f"day{d}"), "day"), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 5
    r = S.merged_profile(stored).first()
    rows = df.collect()
    lengths = [len(x["code"]) for x in rows]
    assert (r["rows"], r["least"], r["most"]) == (2000, min(lengths), max(lengths))
    assert r["n_values"] == len({x["generator"] for x in rows} - {None})
    assert [r["p25"], r["p50"], r["p75"]] == exact_quantiles(lengths)
    top = {x["value"]: x["count"] for x in S.merged_top(stored, 10).collect()}
    counts = sorted((sum(x["generator"] == v for x in rows) for v in {x["generator"] for x in rows} - {None}), reverse=True)
    assert sorted(top.values(), reverse=True) == counts[:10]
    assert all(n == sum(x["generator"] == v for x in rows) for v, n in top.items())


def test_parts_may_be_chosen(spark):
    df = corpus(spark, 500, 20)
    two = S.sketch_parts(df, "day").where("part IN ('day1', 'day3')")
    assert S.merged_profile(two).first()["rows"] == df.where("day IN ('day1', 'day3')").count()


def test_bounds_hold_on_larger_corpora(spark):
    n = 200_000
    df = spark.range(n).select((F.col("id") % 7).alias("day"), F.concat(F.lit("v"), F.col("id") % 50_000).alias("generator"),
                               F.repeat(F.lit("x"), (F.xxhash64("id") % 500 + 500).cast("int")).alias("code"))
    r = S.merged_profile(S.sketch_parts(df, "day")).first()
    assert abs(r["n_values"] - 50_000) <= 4 * 0.0041 * 50_000
    exact = df.select(F.length("code").alias("n")).groupBy("n").count().orderBy("n").collect()
    for p in (25, 50, 75):
        below = sum(x["count"] for x in exact if x["n"] < r[f"p{p}"]) / n
        upto = sum(x["count"] for x in exact if x["n"] <= r[f"p{p}"]) / n
        assert below - 0.004 <= p / 100 <= upto + 0.004


def test_empty_corpus(spark):
    df = spark.createDataFrame([], "day string, generator string, code string")
    parts = S.sketch_parts(df, "day")
    assert parts.collect() == [] and S.merged_top(parts.union(S.sketch_parts(corpus(spark, 10, 3), "day")), 3).count() <= 3
