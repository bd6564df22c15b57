"""Losses over a scored table.

Row terms are pure column expressions on the logits array (log-sum-exp with
``aggregate(transform(...))``), so they stay in whole-stage codegen; the means
are ordinary aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.functions.arrays import log_softmax_at
from labelscope.operators.weights import attach_weights


def cross_entropy_rows(df: DataFrame, logits_col: str = "logits", y_col: str = "y_true",
                       weights: DataFrame | None = None, out: str = "ce",
                       max_classes: int | None = None) -> DataFrame:
    """``ce = -w[y] * log p_y`` per row (w = 1 without weights)."""
    nll = -log_softmax_at(logits_col, y_col)
    if weights is None:
        return df.withColumn(out, nll)
    j = attach_weights(df, weights, y_col, out="_alpha", max_classes=max_classes)
    return j.withColumn(out, F.col("_alpha") * nll).drop("_alpha")


def cross_entropy(df: DataFrame, logits_col: str = "logits", y_col: str = "y_true") -> DataFrame:
    """Unweighted mean cross-entropy."""
    return cross_entropy_rows(df, logits_col, y_col).agg(F.avg("ce").alias("cross_entropy"))


def focal_loss(df: DataFrame, logits_col: str = "logits", y_col: str = "y_true",
               alpha: DataFrame | None = None, gamma: float = 2.0, reduction: str = "mean",
               pt: str = "weighted", max_classes: int | None = None) -> DataFrame:
    """``(1 - pt) ** gamma * ce`` with ``ce`` the (alpha-weighted) CE.

    ``pt="weighted"`` follows the reference code: ``pt = exp(-ce)``, which is
    ``p ** alpha`` when alpha is set (S5). ``pt="unweighted"`` uses the
    documented ``pt = p``. reduction: ``none`` (per-row column ``focal``),
    ``mean`` (divides by row count) or ``sum``."""
    rows = cross_entropy_rows(df, logits_col, y_col, alpha, max_classes=max_classes)
    if pt == "weighted":
        p_t = F.exp(-F.col("ce"))
    elif pt == "unweighted":
        p_t = F.exp(log_softmax_at(logits_col, y_col))
    else:
        raise ValueError("pt must be 'weighted' or 'unweighted'")
    rows = rows.withColumn("focal", F.pow(1 - p_t, F.lit(float(gamma))) * F.col("ce"))
    if reduction == "none":
        return rows
    if reduction == "mean":
        return rows.agg(F.avg("focal").alias("focal_loss"))
    if reduction == "sum":
        return rows.agg(F.sum("focal").alias("focal_loss"))
    raise ValueError("reduction must be none, mean or sum")


def batch_mean_of_means(df: DataFrame, loss_col: str, row_id_col: str = "row_id",
                        batch_size: int = 16) -> DataFrame:
    """A20 (R6 batches ``floor(row_id / batch_size)``): mean of per-batch means,
    so a short last batch weighs as much as a full one (S18)."""
    per_batch = (df.groupBy(F.floor(F.col(row_id_col) / batch_size).alias("batch"))
                 .agg(F.avg(loss_col).alias("batch_loss")))
    return per_batch.agg(F.avg("batch_loss").alias("mean_batch_loss"),
                         F.count(F.lit(1)).alias("n_batches"))
