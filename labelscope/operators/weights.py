"""Class and row weights.

Every weight is computed from the per-class count aggregate (<= one row per
class) and attached to rows by a join on ``label``; never positionally (S7).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.operators.profile import label_counts

BETA = 0.9999


def _weight(method: str, beta: float) -> Column:
    """Weight expression over a per-class count table (one row per class).
    Totals come from a window over that table, so the data is read once."""
    every = Window.partitionBy()  # over <= one row per class
    if method in ("inverse", "balanced"):
        return F.sum("count").over(every) / (F.count(F.lit(1)).over(every) * F.col("count"))
    if method == "effective":
        return (1.0 - beta) / (1.0 - F.pow(F.lit(beta), F.col("count")))
    if method == "reciprocal":
        return 1.0 / F.col("count")
    raise ValueError(f"unknown weighting method {method!r}")


def class_weights(df: DataFrame, method: str = "inverse", label_col: str = "label",
                  beta: float = BETA) -> DataFrame:
    """(label, count, weight).

    inverse / balanced (A9, A11): total / (classes_present * count)
    effective (A10): (1 - beta) / (1 - beta ** count)
    reciprocal (A12): 1 / count
    """
    w = _weight(method, beta)
    return label_counts(df, label_col).select("label", "count", w.cast("double").alias("weight"))


def weights_report(df: DataFrame, label_col: str = "label", beta: float = BETA) -> DataFrame:
    """Both methods side by side, one row per class, from one count aggregate."""
    return label_counts(df, label_col).select(
        "label", "count", _weight("inverse", beta).cast("double").alias("weight_inverse"),
        _weight("effective", beta).cast("double").alias("weight_effective"))


def attach_weights(df: DataFrame, weights: DataFrame, label_col: str = "label",
                   out: str = "weight", max_classes: int | None = None) -> DataFrame:
    """Weight per row by an equi join on the label. The weights table has
    one row per class: broadcast when the caller bounds the classes
    (``max_classes``, e.g. a fixed label list), else AQE decides from the
    runtime size of the (small) weights stage."""
    from labelscope.operators.ranking import bounded_broadcast

    w = weights.select(F.col("label").alias(label_col), F.col("weight").alias(out))
    return df.join(bounded_broadcast(w, max_classes), label_col, "left")
