"""Corpus profiling (A1-A8, A21, S-4, T9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.session import stage_table

from labelscope.functions.labels import label_dimension
from labelscope.functions.text import as_text


def filter_class(df: DataFrame, label, label_col: str = "label") -> DataFrame:
    """Rows of one class (an equality filter that reaches the Parquet scan
    when ``label_col`` is a stored column)."""
    return df.where(F.col(label_col) == F.lit(label))


def select_labels(df: DataFrame, label_col: str = "label") -> DataFrame:
    """The label column alone (Catalyst prunes the scan to it)."""
    return df.select(F.col(label_col))


def label_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A2: (label, count), null labels dropped; partial + final aggregate."""
    return (df.where(F.col(label_col).isNotNull()).groupBy(F.col(label_col).alias("label"))
            .agg(F.count(F.lit(1)).alias("count")))


def label_distribution(spark: SparkSession, df: DataFrame, label_col: str = "label",
                       labels: Sequence[int] | None = None, names: Sequence[str] | None = None,
                       unknown: str = "raise") -> DataFrame:
    """A4: label, name, count, pct = 100*count/total where total counts every
    row, null labels too (S8). An unknown label raises by default (P4) or keeps
    a null name with ``unknown="null"``. One aggregate (the null label is a
    group of its own); the total is a window over its <= K + 1 rows."""
    from pyspark.sql import Window

    counts = (df.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("count"))
              .withColumn("_total", F.sum("count").over(Window.partitionBy()))
              .where(F.col("label").isNotNull()))
    dim = label_dimension(spark, labels, names)
    j = counts.join(F.broadcast(dim), "label", "left")
    name = F.col("name")
    if unknown == "raise":
        name = F.when(F.col("name").isNotNull(), F.col("name")).otherwise(
            F.raise_error(F.concat(F.lit("unknown label "), F.col("label").cast("string"))))
    return j.select("label", name.alias("name"), "count",
                    (100.0 * F.col("count") / F.col("_total")).alias("pct"))


# The line format of the printed class distribution.
DISTRIBUTION_LINE = "  %d: %-15s - %7d samples (%5.2f%%)"


def distribution_lines(dist: DataFrame) -> DataFrame:
    """F4 over A4: one formatted text line per class, in label order (IO9 input)."""
    return dist.select("label", F.format_string(DISTRIBUTION_LINE, "label", "name", "count", "pct")
                       .alias("value"))


def imbalance_ratio(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Max / min class count among present classes."""
    return label_counts(df, label_col).agg(
        (F.max("count") / F.min("count")).alias("imbalance_ratio"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A3: (value, count) ordered by count desc then value."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc(col)))


def top_values(df: DataFrame, col: str, k: int = 20) -> DataFrame:
    """S-4: the k most frequent values, their rank, and how many distinct values
    are left beyond them (clamped at 0, S10). The top-k is the feature. The
    counts are staged once and serve both."""
    from pyspark.sql import Window

    counts = stage_table(df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count")), "value-counts")
    left = max(counts.count() - k, 0)
    top = counts.orderBy(F.desc("count"), F.asc(col)).limit(k)  # TakeOrderedAndProject
    return top.select(col, "count",
                      F.row_number().over(Window.orderBy(F.desc("count"), F.asc(col))).alias("rank"),
                      F.lit(left).cast("bigint").alias("remaining"))


def _text_length(text_col: str, length_col: str | None):
    """Characters of the text, or a precomputed length column."""
    return F.col(length_col) if length_col else F.length(as_text(text_col))


def length_describe(df: DataFrame, text_col: str = "code", length_col: str | None = None,
                    approximate: bool = False, accuracy: int = 10_000) -> DataFrame:
    """A7 over string length (P3): count, mean, std (sample), min, 25/50/75 %
    (linear interpolation), max. Rows are first counted by length, so one task
    sees a row per distinct length, not the rows; ``approximate`` takes the
    quantiles by ``percentile_approx`` (fixed-size sketches) instead."""
    n = _text_length(text_col, length_col)
    by = df.select(n.alias("_len")).where("_len IS NOT NULL").groupBy("_len").agg(F.count(F.lit(1)).alias("_n"))
    probs = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    wide = F.col("_len").cast("decimal(38,0)")
    q = F.percentile("_len", probs, F.col("_n"))
    one = by.agg(F.sum("_n").alias("count"), F.sum(wide * F.col("_n")).cast("double").alias("_s"),
                 F.sum(wide * wide * F.col("_n")).cast("double").alias("_ss"),
                 F.min("_len").cast("double").alias("min"), q.alias("_q"), F.max("_len").cast("double").alias("max"))
    if approximate:
        rough = df.select(n.alias("_len")).agg(F.percentile_approx("_len", probs, accuracy).cast("array<double>").alias("_q"))
        one = one.drop("_q").join(F.broadcast(rough))  # one row each
    mean = F.col("_s") / F.col("count")
    std = F.sqrt(F.greatest((F.col("_ss") - F.col("_s") * mean) / F.nullif(F.col("count") - 1, F.lit(0)), F.lit(0.0)))
    std = F.when(F.col("count") > 1, std)
    return one.select(F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), mean.alias("mean"), std.alias("std"), "min",
                      F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"), "max")


def distinct_count(df: DataFrame, col: str, approximate: bool = False) -> DataFrame:
    """Number of distinct values (exact, or HyperLogLog++ when approximate)."""
    f = F.approx_count_distinct(col) if approximate else F.count_distinct(col)
    return df.agg(f.alias(f"n_{col}"))


def distinct_labels(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A21."""
    return df.select(label_col).where(F.col(label_col).isNotNull()).distinct()


def corpus_profile(df: DataFrame, label_col: str = "label", text_col: str = "code",
                   language_col: str | None = "language",
                   generator_col: str | None = "generator",
                   length_col: str | None = None) -> DataFrame:
    """T9 summary row in one scan: rows, classes, imbalance, languages,
    generators and length statistics (A1, A2, A6, A8, A7).

    One pass counts rows and lengths by (label, language, generator), with the
    text already reduced to its length; the summary folds that small table."""
    cols = {"_label": F.col(label_col), "_n": _text_length(text_col, length_col)}
    outs = []
    for name, col in (("n_languages", language_col), ("n_generators", generator_col)):
        if col and col in df.columns:
            cols[f"_{name}"] = F.col(col)
            outs.append(name)
    by = (df.select(*(c.alias(k) for k, c in cols.items())).groupBy("_label", *(f"_{o}" for o in outs))
          .agg(F.count(F.lit(1)).alias("rows"), F.sum("_n").alias("_len"), F.min("_n").alias("_lo"), F.max("_n").alias("_hi")))
    by = stage_table(by, "profile-counts")  # two folds of it below, one read of the texts
    total = by.agg(F.sum("rows").cast("bigint").alias("rows"), (F.sum("_len") / F.sum("rows")).alias("mean_length"),
                   F.min("_lo").cast("bigint").alias("min_length"), F.max("_hi").cast("bigint").alias("max_length"),
                   *(F.count_distinct(f"_{o}").alias(o) for o in outs))
    classes = (by.where("_label IS NOT NULL").groupBy("_label").agg(F.sum("rows").alias("rows"))
               .agg(F.count(F.lit(1)).alias("n_classes"), (F.max("rows") / F.min("rows")).alias("imbalance_ratio")))
    return total.join(F.broadcast(classes))  # one row each
