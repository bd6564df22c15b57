"""Streaming use of the row-level operators (no state is kept)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.functions.arrays import argmax, log_softmax_at


def score_stream(stream: DataFrame, logits_col: str = "logits", y_col: str | None = "y_true") -> DataFrame:
    """Add ``y_pred`` (M9) and, with a truth column, ``correct`` (P8) and the
    per-row cross-entropy ``ce`` (M10 row form) to a streaming DataFrame."""
    out = stream.withColumn("y_pred", argmax(logits_col))
    if y_col:
        out = (out.withColumn("correct", (F.col(y_col) == F.col("y_pred")).cast("int"))
               .withColumn("ce", -log_softmax_at(logits_col, y_col)))
    return out
