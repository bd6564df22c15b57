"""Training history tables (T7, T12, W-1, W-2, P12, P13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = ("epoch", "train_loss", "train_f1", "val_f1")


def history_series(history: DataFrame) -> DataFrame:
    """Required columns checked, ``val_loss`` defaulting to 0, and
    ``plot_val_loss`` = whether any val_loss is nonzero."""
    missing = [c for c in REQUIRED if c not in history.columns]
    if missing:
        raise ValueError(f"history lacks {missing}")
    vl = F.coalesce(F.col("val_loss").cast("double"), F.lit(0.0)) if "val_loss" in history.columns \
        else F.lit(0.0)
    h = history.select(F.col("epoch").cast("int").alias("epoch"),
                       F.col("train_loss").cast("double").alias("train_loss"),
                       F.col("train_f1").cast("double").alias("train_f1"),
                       F.col("val_f1").cast("double").alias("val_f1"), vl.alias("val_loss"))
    # one row per epoch: the window runs over the (small) history itself
    any_nonzero = F.coalesce(F.bool_or(F.col("val_loss") != 0).over(Window.partitionBy()), F.lit(False))
    return h.withColumn("plot_val_loss", any_nonzero)


def checkpoint_events(history: DataFrame, metric: str = "val_f1", order: str = "epoch") -> DataFrame:
    """W-1: epochs whose metric is strictly above every earlier one, starting
    from 0 (S20). One row per epoch is a small table; the frame window runs
    over it in one partition."""
    prev_best = F.max(metric).over(
        Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return (history.withColumn("_prev", F.coalesce(prev_best, F.lit(0.0)))
            .where(F.col(metric) > F.col("_prev")).drop("_prev"))


def best_epoch(history: DataFrame, metric: str = "val_f1", order: str = "epoch") -> DataFrame:
    """W-2: earliest epoch with the top metric, if it is above 0; else no row."""
    return history.where(F.col(metric) > 0).orderBy(F.desc(metric), F.asc(order)).limit(1)
