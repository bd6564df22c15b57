"""History windows, text encoding, weights, losses and group accuracy."""

import json
import math

import pytest

from labelscope.functions.text import metadata_prefix
from labelscope.operators import encode, groups, history, losses, profile, weights
from labelscope.sources import io


def test_checkpoint_and_best(spark):
    h = spark.createDataFrame([(1, 0.2), (2, 0.1), (3, 0.4), (4, 0.4), (5, 0.3)],
                              "epoch INT, val_f1 DOUBLE")
    assert [r["epoch"] for r in history.checkpoint_events(h).orderBy("epoch").collect()] == [1, 3]
    assert history.best_epoch(h).first()["epoch"] == 3
    zero = spark.createDataFrame([(1, 0.0), (2, 0.0)], "epoch INT, val_f1 DOUBLE")
    assert history.checkpoint_events(zero).count() == 0 and history.best_epoch(zero).count() == 0


def test_history_json(spark, tmp_path):
    p = tmp_path / "history.json"
    p.write_text(json.dumps([{"epoch": 1, "train_loss": 1.0, "train_f1": 0.2, "val_f1": 0.3},
                             {"epoch": 2, "train_loss": 0.5, "train_f1": 0.4, "val_f1": 0.5}], indent=2))
    s = history.history_series(io.read_history(spark, str(p))).collect()
    assert [r["val_loss"] for r in s] == [0.0, 0.0] and not s[0]["plot_val_loss"]


def test_encode_pad_truncate_unknown(spark):
    df = spark.createDataFrame([(1, "a b a c"), (2, "  b\tz\n"), (3, ""), (4, None)],
                               "doc_id INT, code STRING")
    v = encode.vocabulary(df, size=2)
    assert [(r["token"], r["id"]) for r in v.orderBy("id").collect()] == [("a", 2), ("b", 3)]
    e = {r["doc_id"]: r for r in encode.encode(df, v, "doc_id", max_length=3).collect()}
    assert e[1]["input_ids"] == [2, 3, 2] and e[1]["attention_mask"] == [1, 1, 1]
    assert e[2]["input_ids"] == [3, 1, 0] and e[2]["attention_mask"] == [1, 1, 0]
    assert e[3]["input_ids"] == [0, 0, 0] and e[4]["attention_mask"] == [0, 0, 0]


def test_metadata_prefix(spark):
    df = spark.createDataFrame([("x = 1", "Python")], "code STRING, language STRING")
    assert df.select(metadata_prefix("code", "language")).first()[0] == "# Language: Python\nx = 1"


def test_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2 + [(None,)], "label INT")
    w = {r["label"]: r["weight"] for r in weights.class_weights(df, "inverse").collect()}
    assert w == {0: 8 / (2 * 6), 1: 8 / (2 * 2)}
    e = {r["label"]: r["weight"] for r in weights.class_weights(df, "effective").collect()}
    assert abs(e[1] - (1 - 0.9999) / (1 - 0.9999 ** 2)) < 1e-15


def test_focal_matches_closed_form(spark):
    df = spark.createDataFrame([([0.0, math.log(3.0)], 1)], "logits ARRAY<DOUBLE>, y_true INT")
    alpha = spark.createDataFrame([(1, 2.0)], "label INT, weight DOUBLE")
    r = losses.focal_loss(df, alpha=alpha, gamma=2.0, reduction="none").first()
    ce = -2.0 * math.log(0.75)
    assert abs(r["ce"] - ce) < 1e-12
    assert abs(r["focal"] - (1 - math.exp(-ce)) ** 2 * ce) < 1e-12
    doc = losses.focal_loss(df, alpha=alpha, gamma=2.0, reduction="none", pt="unweighted").first()
    assert abs(doc["focal"] - (0.25 ** 2) * ce) < 1e-12


def test_group_accuracy_and_distribution(spark):
    df = spark.createDataFrame([("Go", 1, 1), ("Go", 1, 0), ("C", 0, 0), (None, 1, 1)],
                               "language STRING, y_true INT, y_pred INT")
    acc = {r["language"]: (r["accuracy"], r["count"])
           for r in groups.accuracy_by_group(groups.with_correct(df), "language").collect()}
    assert acc == {"Go": (0.5, 2), "C": (1.0, 1)}
    d = spark.createDataFrame([(0,), (0,), (1,), (None,)], "label INT")
    dist = {r["label"]: r["pct"] for r in profile.label_distribution(spark, d).collect()}
    assert dist == {0: 50.0, 1: 25.0}  # the null row counts in the denominator
    bad = spark.createDataFrame([(42,)], "label INT")
    with pytest.raises(Exception, match="unknown label 42"):
        profile.label_distribution(spark, bad).collect()


def test_top_values_remainder_clamped(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "g STRING")
    rows = profile.top_values(df, "g", 20).collect()
    assert [(r["g"], r["count"], r["remaining"]) for r in rows] == [("a", 2, 0), ("b", 1, 0)]


def test_length_describe(spark):
    df = spark.createDataFrame([("a",), ("ab",), ("abcd",), ("abcdefghi",)], "code STRING")
    r = profile.length_describe(df).first()
    assert r["p25"] == 1.75 and r["count"] == 4 and r["max"] == 9.0


def test_names_filter_select(spark):
    import pytest
    from labelscope.functions.labels import attach_names
    from labelscope.operators import profile

    df = spark.createDataFrame([(1, 0), (2, 10), (3, None)], "id INT, label INT")
    got = {r["id"]: r["name"] for r in attach_names(spark, df).collect()}
    assert got == {1: "Human", 2: "OpenAI", 3: None}
    bad = spark.createDataFrame([(1, 11)], "id INT, label INT")
    with pytest.raises(Exception, match="unknown label 11"):
        attach_names(spark, bad).collect()
    assert attach_names(spark, bad, unknown="null").first()["name"] is None
    assert profile.filter_class(df, 10).count() == 1
    assert profile.select_labels(df).columns == ["label"]


def test_agreement_check(spark):
    a = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id INT, label INT")
    b = spark.createDataFrame([(1, 0), (2, 2), (3, 2)], "id INT, label INT")
    r = groups.agreement(a, b, check=True).first()
    assert r["n"] == 3 and r["differences"] == 1 and abs(r["agreement"] - 2 / 3) < 1e-12
    with pytest.raises(ValueError):
        groups.agreement(a, b.where("id < 3"), check=True).collect()


def test_distinct_count_exact_and_approximate(spark):
    from conftest import SF_MID

    df = spark.read.parquet(f"{SF_MID}/lineitem.parquet").select("l_orderkey")
    exact = profile.distinct_count(df, "l_orderkey").first()[0]
    approx = profile.distinct_count(df, "l_orderkey", approximate=True).first()[0]
    assert exact == df.distinct().count()
    assert abs(approx - exact) <= 0.1 * exact


def test_length_describe_approximate(spark):
    from conftest import SF_MID

    from labelscope.plans import roles

    c = roles.corpus(spark, SF_MID)
    exact = profile.length_describe(c).first()
    approx = profile.length_describe(c, approximate=True).first()
    assert exact["count"] == approx["count"] and exact["max"] == approx["max"]
    for k in ("p25", "p50", "p75"):
        assert abs(approx[k] - exact[k]) <= 0.02 * exact["max"]


def test_a_vocabulary_past_the_bound_is_joined(spark):
    import random

    from labelscope.operators import encode

    rng = random.Random(3)
    rows = [(i // 2, " ".join(rng.choice(["the", "of"] + [f"w{k}" for k in range(60)]) for _ in range(rng.randrange(0, 40))) if i % 9 else None)
            for i in range(120)]
    df = spark.createDataFrame(rows, "id long, code string").repartition(3)
    vocab = encode.vocabulary(df, "code", 50)
    expect = sorted(map(tuple, encode.encode(df, vocab, "id", max_length=20).collect()), key=str)
    for limit in (0, 40, 100):
        got = encode.encode(df, vocab, "id", max_length=20, vocabulary_bytes=limit)
        assert got.columns == ["id", "input_ids", "attention_mask"]
        assert sorted(map(tuple, got.collect()), key=str) == expect
