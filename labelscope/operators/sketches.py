"""Profiles from stored, mergeable sketches (A1, A3, A7, A8, S-4).

A corpus that grows by days or files keeps one sketch row per part: distinct
values (HyperLogLog), text lengths (KLL quantiles) and frequent values. A new
part is sketched from its own rows and appended; the profile of any set of parts
merges their rows and reads no old text. All sketches are Spark's own
aggregates, partial before the shuffle.

Bounds (the exact ways, ``profile`` and ``cube``, stay): the distinct count has a
standard error of 1.04 / sqrt(2**LOG_K), 0.4 %, and is exact to rounding while there are
few values; a quantile's rank is off by at most about 0.1 % of the rows, and none
while the rows are no more than ``QUANTILE_K``; the counts of frequent values
are exact while there are fewer than three quarters of ``TRACKED`` values, else
at most too large by a share of about 3.5 / ``TRACKED`` of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.functions.text import as_text

LOG_K = 16
QUANTILE_K = 4096
TRACKED = 8192
PROBABILITIES = (0.25, 0.5, 0.75)


def sketch_parts(df: DataFrame, part_col: str, value_col: str = "generator", text_col: str = "code") -> DataFrame:
    """``(part, rows, least, most, n_values, lengths, frequent)``: a row of
    sketches per part; null values are counted in ``rows`` only."""
    base = df.select(F.col(part_col).cast("string").alias("part"), F.col(value_col).cast("string").alias("value"),
                     F.length(as_text(text_col)).cast("bigint").alias("length"))
    return base.groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.min("length").alias("least"), F.max("length").alias("most"),
        F.hll_sketch_agg("value", LOG_K).alias("n_values"), F.kll_sketch_agg_bigint("length", QUANTILE_K).alias("lengths"),
        F.expr(f"approx_top_k_accumulate(value, {TRACKED}) FILTER (WHERE value IS NOT NULL)").alias("frequent"))


def add_parts(sketches: DataFrame, path: str) -> None:
    """Append sketch rows to the stored table."""
    sketches.write.mode("append").parquet(path)


def merged_profile(sketches: DataFrame, probabilities: Sequence[float] = PROBABILITIES) -> DataFrame:
    """One row of all parts: rows, distinct values, least, quantiles, most length."""
    one = sketches.agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("n_values")).alias("n_values"),
                       F.min("least").alias("least"), F.max("most").alias("most"),
                       F.kll_merge_agg_bigint("lengths", QUANTILE_K).alias("_lengths"))
    points = [F.kll_sketch_get_quantile_bigint("_lengths", F.lit(float(p))).alias(f"p{round(100 * p)}") for p in probabilities]
    return one.select("rows", "n_values", "least", *points, "most")


def merged_top(sketches: DataFrame, k: int = 20) -> DataFrame:
    """``(value, count)`` of the ``k`` most frequent values of all parts."""
    # grouped by a constant: the ungrouped aggregate fails on empty partitions
    one = sketches.groupBy(F.lit(1).alias("all")).agg(F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("f"))
    return one.select(F.explode(F.expr(f"approx_top_k_estimate(f, {k})")).alias("x")).select(
        F.col("x.item").alias("value"), F.col("x.count").alias("count"))
