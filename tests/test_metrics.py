"""Metric operators against the reference's published test-split report."""

import pytest
from pyspark.sql import functions as F

from labelscope.operators import metrics

# Margins of the reference's test split (support, predicted, TP per class).
SUPPORT = [474, 21, 73, 21, 10, 36, 54, 61, 18, 18, 214]
PREDICTED = [467, 43, 97, 28, 12, 47, 28, 41, 41, 30, 166]
TP = [456, 3, 25, 8, 2, 22, 10, 9, 5, 4, 133]
# The published report rows (precision, recall, f1) to 3 digits.
REPORT = [
    (0.976, 0.962, 0.969), (0.070, 0.143, 0.094), (0.258, 0.342, 0.294), (0.286, 0.381, 0.327),
    (0.167, 0.200, 0.182), (0.468, 0.611, 0.530), (0.357, 0.185, 0.244), (0.220, 0.148, 0.176),
    (0.122, 0.278, 0.169), (0.133, 0.222, 0.167), (0.801, 0.621, 0.700),
]
MACRO = (0.351, 0.372, 0.350)
WEIGHTED = (0.716, 0.677, 0.690)


def golden_pairs():
    """1,000 (y_true, y_pred) pairs with the published margins; off-diagonal
    cells filled greedily (any filling gives the same metrics)."""
    k = len(SUPPORT)
    rows = [s - t for s, t in zip(SUPPORT, TP)]
    cols = [p - t for p, t in zip(PREDICTED, TP)]
    cells = {(i, i): TP[i] for i in range(k)}
    for i in range(k):
        for j in range(k):
            if i != j and rows[i] and cols[j]:
                m = min(rows[i], cols[j])
                cells[(i, j)] = cells.get((i, j), 0) + m
                rows[i] -= m
                cols[j] -= m
    # a leftover can only sit on the diagonal (row i and column i): move one
    # unit of some off-diagonal cell (a, b) to (a, i) and (i, b) until none is left
    for i in range(k):
        while rows[i]:
            a, b = next(c for c, n in cells.items() if n and c[0] != c[1] and i not in c)
            cells[(a, b)] -= 1
            cells[(a, i)] = cells.get((a, i), 0) + 1
            cells[(i, b)] = cells.get((i, b), 0) + 1
            rows[i] -= 1
            cols[i] -= 1
    assert not any(rows) and not any(cols)
    return [(i, j) for (i, j), n in cells.items() for _ in range(n)]


@pytest.fixture(scope="module")
def pairs(spark):
    df = spark.createDataFrame(golden_pairs(), "y_true INT, y_pred INT").repartition(5)
    return metrics.pair_counts(df).cache()


def test_macro_f1_and_accuracy(pairs):
    rec = metrics.metrics_record(pairs).first()
    assert abs(rec["macro_f1"] - 0.3501863512702263) < 1e-15
    assert abs(rec["accuracy"] - 0.677) < 1e-15


def test_per_class_report(spark, pairs):
    rep = metrics.classification_report(spark, pairs, list(range(11)), strict=True)
    rows = {r["row_order"]: r for r in rep.collect()}
    for i, (p, r, f) in enumerate(REPORT):
        assert (rows[i]["precision"], rows[i]["recall"], rows[i]["f1_score"]) == (p, r, f), i
        assert rows[i]["support"] == SUPPORT[i]
    assert rows[11]["name"] == "accuracy" and rows[11]["f1_score"] == 0.677
    assert (rows[12]["precision"], rows[12]["recall"], rows[12]["f1_score"]) == MACRO
    assert (rows[13]["precision"], rows[13]["recall"], rows[13]["f1_score"]) == WEIGHTED
    assert rows[13]["support"] == 1000


def test_confusion_sums(spark, pairs):
    cm = metrics.confusion_matrix(spark, pairs, list(range(11)))
    assert cm.count() == 121
    assert cm.agg(F.sum("n")).first()[0] == 1000
    diag = {r["y_true"]: r["n"] for r in cm.where("y_true = y_pred").collect()}
    assert [diag[i] for i in range(11)] == TP
    wide = metrics.confusion_wide(spark, pairs, list(range(11))).collect()
    assert [sum(r[str(j)] for j in range(11)) for r in wide] == SUPPORT


def test_normalized_empty_row_is_null(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "y_true INT, y_pred INT")
    cm = metrics.confusion_normalized(spark, metrics.pair_counts(df), [0, 1, 2])
    got = {(r["y_true"], r["y_pred"]): r["share"] for r in cm.collect()}
    assert got[(0, 0)] == 0.5 and got[(1, 1)] == 1.0 and got[(2, 2)] is None


def test_macro_present_vs_fixed(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (1, 0)], "y_true INT, y_pred INT")
    p = metrics.pair_counts(df)
    present = metrics.macro_f1(p).first()[0]
    fixed = metrics.macro_f1_fixed(spark, p, [0, 1, 2]).first()[0]
    assert abs(present - (2 / 3 + 2 / 3) / 2) < 1e-12
    assert abs(fixed - (2 / 3 + 2 / 3) / 3) < 1e-12


def test_argmax_tie_lowest_index(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([5.0, 1.0, 5.0],)], "logits ARRAY<DOUBLE>")
    assert [r[0] for r in metrics.predict_argmax(df).select("y_pred").collect()] == [1, 0]


def test_strict_report_raises_on_missing_class(spark):
    df = spark.createDataFrame([(0, 0), (1, 1)], "y_true INT, y_pred INT")
    with pytest.raises(Exception, match="does not match"):
        metrics.classification_report(spark, metrics.pair_counts(df), [0, 1, 2], strict=True).collect()


def test_f1_series_flags(spark, pairs):
    s = {r["label"]: r for r in metrics.f1_series(spark, pairs, list(range(11))).collect()}
    assert s[0]["above_half"] and not s[1]["above_half"]
    assert abs(s[0]["macro_f1"] - 0.3501863512702263) < 1e-12
