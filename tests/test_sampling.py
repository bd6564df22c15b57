"""Sampling properties: exact sizes, subset, no duplicates, determinism
independent of partitioning, bucketed rank == plain rank."""

import hashlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from labelscope.functions.hashing import seeded_key
from labelscope.operators import ranking, sampling

from conftest import SF_MID


@pytest.fixture(scope="module")
def skewed(spark):
    # orders: class 0 holds 88 % of the rows (the hot class)
    o = spark.read.parquet(f"{SF_MID}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    m = F.col("id") % 25
    return o.select("id", F.when(m < 22, 0).otherwise(m - 21).cast("int").alias("label")).cache()


def _counts(df):
    return {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}


def test_bucketed_rank_equals_row_number(spark, skewed):
    keyed = skewed.withColumn("_key", seeded_key(7, "id"))
    plain = keyed.withColumn("r1", F.row_number().over(
        Window.partitionBy("label").orderBy("_key", "id")))
    for digits, parts, domain in [(1, 1, 4), (2, 7, 4), (3, 13, None), (5, 3, 4)]:
        b = ranking.bucketed_rank(keyed.repartition(parts), "_key", ["id"], ["label"], digits=digits,
                                  domain_size=domain, rank_col="r2")
        j = plain.join(b.select("id", "r2"), "id")
        assert j.count() == skewed.count()
        assert j.where("r1 <> r2").count() == 0


def test_sample_by_class_exact_and_deterministic(spark, skewed):
    a = sampling.sample_by_class(spark, skewed, 500, labels=[0, 1, 2, 3])
    b = sampling.sample_by_class(spark, skewed.repartition(11), 500, labels=[0, 1, 2, 3])
    ca = _counts(a)
    full = _counts(skewed)
    assert ca == {k: min(500, v) for k, v in full.items()}
    assert a.select("id").distinct().count() == a.count()          # no duplicates
    assert a.join(skewed, ["id", "label"], "left_anti").count() == 0  # subset
    assert sorted(r["id"] for r in a.collect()) == sorted(r["id"] for r in b.collect())
    ids = sorted(r["row_id"] for r in a.collect())
    assert ids == list(range(a.count()))                            # consecutive row ids


def test_seed_changes_sample(spark, skewed):
    a = {r["id"] for r in sampling.sample_n(skewed, 300, seed=1).collect()}
    b = {r["id"] for r in sampling.sample_n(skewed, 300, seed=2).collect()}
    assert len(a) == len(b) == 300 and a != b


def test_balance_majority_sizes(spark, skewed):
    full = _counts(skewed)
    out = sampling.balance_majority(spark, skewed, 1000, labels=[0, 1, 2, 3])
    got = _counts(out)
    assert got[0] == 1000 and all(got[k] == full[k] for k in (1, 2, 3))
    over = sampling.balance_majority(spark, skewed, 1000, True, 700, labels=[0, 1, 2, 3])
    got = _counts(over)
    assert got == {0: 1000, 1: 700, 2: 700, 3: 700}
    # a bootstrapped class draws with replacement from its own rows only
    drawn = over.where(F.col("sample_key").startswith("d:"))
    assert drawn.join(skewed, ["id", "label"], "left_anti").count() == 0


def test_keep_all_when_majority_small(spark, skewed):
    full = _counts(skewed)
    out = sampling.balance_majority(spark, skewed, 10 ** 9, labels=[0, 1, 2, 3])
    assert _counts(out) == full


def test_balance_equal(spark, skewed):
    out = sampling.balance_equal(spark, skewed, 800, labels=[0, 1, 2, 3])
    assert _counts(out) == {0: 800, 1: 800, 2: 800, 3: 800}
    assert out.select("sample_key").distinct().count() == 3200


def test_empty_class_with_replacement_raises(spark, skewed):
    with pytest.raises(Exception, match="empty class 5"):
        sampling.balance_equal(spark, skewed, 800, labels=[0, 1, 2, 3, 5]).collect()


def test_target_without_oversample_raises(spark, skewed):
    with pytest.raises(ValueError):
        sampling.balance_majority(spark, skewed, 10, False, 100)


def test_with_replacement_draw_counts(spark, skewed):
    out = sampling.sample_with_replacement(spark, skewed, 50, labels=[0, 1, 2, 3])
    assert _counts(out) == {0: 50, 1: 50, 2: 50, 3: 50}
    assert out.select("label", "draw").distinct().count() == 200


def test_weighted_sampler_uniform_classes(spark, skewed):
    out = sampling.weighted_sample(spark, skewed, labels=[0, 1, 2, 3])
    n = skewed.count()
    got = _counts(out)
    assert sum(got.values()) == n
    for v in got.values():  # each class ~ n/4 although class 0 holds 88 % of rows
        assert abs(v - n / 4) < 0.05 * n


def test_row_ids_consecutive(spark, skewed):
    out = ranking.row_ids(skewed.repartition(5), "id")
    rows = sorted((r["id"], r["row_id"]) for r in out.collect())
    assert [r for _, r in rows] == list(range(len(rows)))


def test_reports(spark, skewed):
    out = sampling.balance_majority(spark, skewed, 1000, labels=[0, 1, 2, 3])
    rep = sampling.balance_report(skewed, out).first()
    assert rep["rows_before"] == skewed.count() and rep["rows_after"] == out.count()
    audit = {r["label"]: r["action"] for r in sampling.balance_audit(skewed, out).collect()}
    assert audit[0] == "undersampled" and audit[1] == "kept"


def test_audit_lines_all_actions(spark, skewed):
    out = sampling.balance_majority(spark, skewed, 1000, labels=[0, 1, 2, 3], shuffle=False)
    audit = sampling.balance_audit(skewed, out)
    lines = {r["label"]: r["value"] for r in sampling.balance_audit_lines(
        spark, audit, [0, 1, 2, 3], ["Human", "DeepSeek-AI", "Qwen", "01-ai"]).collect()}
    n = _counts(skewed)
    assert lines[0] == f"Undersampling: {n[0]} -> 1000 samples"
    assert lines[1] == f"Label 1 (DeepSeek-AI    ): {n[1]:6d} samples (kept all)"


def test_draws_hit_the_ranked_rows(spark, skewed):
    """Each draw's row is the row of its rank, whatever the partitioning."""
    counts = sampling.class_counts(skewed, "label", [0, 1, 2, 3])
    draw = {c: 300 for c in counts}
    kw = dict(seed=9, id_cols=["id"], label_col="label", shuffle=False)
    for digits in (1, 5):
        got = {r["sample_key"]: r["id"] for r in sampling.execute_plan(
            spark, skewed.repartition(7), counts, {}, draw, digits=digits, **kw).collect()}
        rows = {(r["label"], r["id"]) for r in skewed.select("label", "id").collect()}
        order = {c: sorted((hashlib.md5(f"9:{i}".encode()).hexdigest(), i) for k, i in rows if k == c) for c in counts}
        assert len(got) == 4 * 300
        for key, i in got.items():
            _, c, d = key.split(":")
            rank = int(hashlib.md5(f"9:{c}:{d}".encode()).hexdigest()[:15], 16) % counts[int(c)]
            assert order[int(c)][rank][1] == i


@pytest.mark.parametrize("size", [3_000_000_000, 300_000_000_000])
def test_draws_are_uniform_in_huge_classes(spark, size):
    gen = sampling._draws(spark, "label", {1: 40_000}, {1: size}, 7)
    r = gen.agg(F.max("_rank").alias("top"), F.avg((F.col("_rank") <= 0.432 * size).cast("double")).alias("share"),
                F.count("*").alias("n"), F.min("_rank").alias("low")).first()
    assert r["n"] == 40_000 and r["low"] >= 1
    assert 0.999 * size < r["top"] <= size
    assert abs(r["share"] - 0.432) < 0.01


def test_repeated_ids_raise(spark, skewed):
    twice = skewed.unionByName(skewed)
    with pytest.raises(Exception, match="not unique"):
        sampling.sample_by_class(spark, twice, 50, labels=[0], shuffle=False).collect()
    with pytest.raises(Exception, match="not unique"):
        ranking.row_ids(twice, "id").collect()


def test_row_ids_on_an_empty_table(spark, skewed):
    assert ranking.row_ids(skewed.where("id < -1"), "id").count() == 0


def test_weighted_sampler_rejects_null_labels(spark, skewed):
    with pytest.raises(ValueError, match="null"):
        sampling.weighted_sample(spark, skewed.withColumn("label", F.when(F.col("id") > 5, F.col("label"))))


def test_no_broadcast_path_gives_same_rows(spark, skewed, monkeypatch):
    def run():
        a = sampling.balance_equal(spark, skewed, 700, labels=[0, 1, 2, 3], seed=3)
        b = sampling.sample_n(skewed, 900, seed=3)
        c = ranking.row_ids(skewed, "id", out="rid")
        return (sorted((r["sample_key"], r["row_id"]) for r in a.collect()),
                sorted((r["id"], r["sample_rank"]) for r in b.collect()),
                sorted((r["id"], r["rid"]) for r in c.collect()))

    with_broadcast = run()
    # no hint from us and no size-based broadcast from Spark: sort-merge joins
    monkeypatch.setattr(ranking, "BROADCAST_ROW_LIMIT", 0)
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        plan = sampling.sample_n(skewed, 900, seed=3)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
        assert run() == with_broadcast
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_class_spread_over_window_tasks(spark, skewed):
    """The plain per-class row_number puts the whole 88 % class in one task;
    the bucketed rank spreads it over the shuffle partitions."""
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        keyed = skewed.withColumn("_key", seeded_key(1, "id"))
        plain = keyed.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("_key")))
        bucketed = ranking.bucketed_rank(keyed, "_key", ["id"], ["label"], domain_size=4)

        def biggest_share(df):
            per = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
            return max(r["count"] for r in per) / sum(r["count"] for r in per)

        assert biggest_share(plain) > 0.85
        assert biggest_share(bucketed) < 0.15
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_report_counts_dropped_and_null_labels(spark):
    df = spark.createDataFrame([(i, lab) for i, lab in enumerate([0] * 6 + [1] * 2 + [11, None])],
                               "id BIGINT, label INT")
    out = sampling.balance_majority(spark, df, 3, labels=[0, 1], shuffle=False)
    rep = sampling.balance_report(df, out, labels=[0, 1]).first()
    assert rep["rows_before"] == 10 and rep["rows_after"] == 5 and rep["rows_dropped"] == 2
    assert rep["imbalance_before"] == 6.0 and abs(rep["imbalance_after"] - 1.5) < 1e-12


def test_plan_table_path_equals_case_path(spark, skewed, monkeypatch):
    def run():
        a = sampling.balance_equal(spark, skewed, 700, labels=[0, 1, 2, 3], seed=5)
        b = sampling.weighted_sample(spark, skewed, seed=5, labels=[0, 1, 2, 3])
        return (sorted((r["sample_key"], r["row_id"]) for r in a.collect()),
                sorted((r["draw_id"], r["id"]) for r in b.collect()))

    case_path = run()
    monkeypatch.setattr(sampling, "CASE_MAX_CLASSES", 0)
    assert run() == case_path
