"""Grouped evaluation and prediction-set comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def align_full(pred: DataFrame, truth: DataFrame, key: str, pred_col: str = "label",
               out: str = "predicted") -> DataFrame:
    """J1 as one full outer join with side markers ``_in_pred`` / ``_in_truth``:
    a row's number among those of its side and key (1 when the key is unique,
    null without a row), so unmatched and repeated keys of either side are found
    without another join. Numbers and join share one exchange by key."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(key))
    p = pred.select(F.col(key), F.col(pred_col).alias(out)).withColumn("_in_pred", number)
    t = truth.withColumn("_in_truth", number)
    return t.join(p, key, "full_outer")


def matched(full: DataFrame, check: bool = True, key: str = "key") -> DataFrame:
    """Rows of ``align_full`` present on both sides; ``check`` raises when a
    row on either side has no partner (the reference's unequal-length error)
    or a key is repeated. Persist ``full`` first when it is used for both."""
    both = F.col("_in_pred").isNotNull() & F.col("_in_truth").isNotNull()
    if check and full.where(~both | (F.col("_in_pred") > 1) | (F.col("_in_truth") > 1)).limit(1).count():
        raise ValueError("prediction and truth tables do not match one to one on " + key)
    return full.where(both).drop("_in_pred", "_in_truth")


def align(pred: DataFrame, truth: DataFrame, key: str, pred_col: str = "label",
          out: str = "predicted", check: bool = False) -> DataFrame:
    """Equi join on a key (S1). Output: truth columns + ``out``.
    With ``check``, one full outer join serves both the check and the result."""
    if not check:
        p = pred.select(F.col(key), F.col(pred_col).alias(out))
        return truth.join(p, key, "inner")
    return matched(align_full(pred, truth, key, pred_col, out), True, key)


def with_correct(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                 out: str = "correct") -> DataFrame:
    """0/1 correctness flag (0 where a side is missing)."""
    return df.withColumn(out, F.coalesce(F.col(y_true) == F.col(y_pred), F.lit(False)).cast("int"))


def accuracy_by_group(df: DataFrame, group_col: str, correct_col: str = "correct",
                      digits: int | None = 3) -> DataFrame:
    """(group, accuracy, count); null group dropped; rounded half-even."""
    acc = F.avg(correct_col)
    if digits is not None:
        acc = F.bround(acc, digits)
    return (df.where(F.col(group_col).isNotNull()).groupBy(group_col)
            .agg(acc.alias("accuracy"), F.count(correct_col).alias("count")))


def accuracy_ranking(df: DataFrame, group_col: str, correct_col: str = "correct") -> DataFrame:
    """Unrounded group accuracy, worst first, ties by key."""
    return (accuracy_by_group(df, group_col, correct_col, digits=None).drop("count")
            .orderBy("accuracy", group_col))


def agreement_row(paired: DataFrame, same: Column) -> DataFrame:
    """A18/A19 of rows that hold both labels: n, agreement, differences, percent."""
    return paired.agg(F.count(F.lit(1)).alias("n"), F.avg(same.cast("double")).alias("agreement"),
                      F.count_if(~same).alias("differences")).withColumn(
        "difference_pct", 100.0 * F.col("differences") / F.col("n"))


def agreement(a: DataFrame, b: DataFrame, key: str = "id", label_col: str = "label",
              check: bool = False) -> DataFrame:
    """T11 / A18 / A19 in one aggregate after J3: agreement, differences, percent.
    ``check`` (S22) raises unless both sets cover the same keys."""
    left = a.select(key, F.col(label_col).alias("_a"))
    if check:
        j = matched(align_full(b, left, key, pred_col=label_col, out="_b"), True, key)
    else:
        j = left.join(b.select(key, F.col(label_col).alias("_b")), key, "inner")
    same = F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))  # a missing label agrees with nothing
    return agreement_row(j, same)


def differences(a: DataFrame, b: DataFrame, key: str = "id", label_col: str = "label") -> DataFrame:
    """Rows where the two prediction sets differ (a missing label differs)."""
    j = a.select(key, F.col(label_col).alias("label_a")).join(
        b.select(key, F.col(label_col).alias("label_b")), key, "inner")
    return j.where(F.coalesce(F.col("label_a") != F.col("label_b"), F.lit(True)))
