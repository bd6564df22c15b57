"""The corpus profile from one aggregate (T9; A1-A4, A6-A8, S-4).

``profile_cube`` reads the corpus once and counts its rows by label, by language,
by generator and by text length in one ``GROUPING SETS`` aggregate: one scan, one
exchange, one row per value. Every table below folds that small table, which
also merges: cubes of several days or files add up (``merge_cubes``), so old
data need not be read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelscope.functions.labels import label_dimension
from labelscope.functions.text import as_text

PARTS = ("label", "language", "generator", "length")


def profile_cube(df: DataFrame, label_col: str = "label", text_col: str = "code", language_col: str = "language",
                 generator_col: str = "generator") -> DataFrame:
    """``(part, label, language, generator, length, rows)``: for each part (what the
    rows are counted by) a row per value, null among them; a corpus without the
    language or generator column has nulls there."""
    def col(name: str):
        return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")

    base = df.select(F.col(label_col).cast("int").alias("label"), col(language_col).alias("language"), col(generator_col).alias("generator"),
                     F.length(as_text(text_col)).alias("length"))
    sets = base.groupingSets([[p] for p in PARTS], *PARTS)
    counted = sets.agg(F.count(F.lit(1)).alias("rows"), F.grouping_id().alias("_set"))
    part = F.lit(None).cast("string")
    for i, name in enumerate(PARTS):  # a grouping id has a 0 bit where the column is kept
        part = F.when(F.col("_set") == 2 ** len(PARTS) - 1 - 2 ** (len(PARTS) - 1 - i), name).otherwise(part)
    return counted.select(part.alias("part"), *PARTS, "rows")


def merge_cubes(*cubes: DataFrame) -> DataFrame:
    """The cube of all corpora together."""
    rows = cubes[0]
    for cube in cubes[1:]:
        rows = rows.unionByName(cube)
    return rows.groupBy("part", *PARTS).agg(F.sum("rows").cast("bigint").alias("rows"))


def _counts(cube: DataFrame, part: str) -> DataFrame:
    return cube.where((F.col("part") == part) & F.col(part).isNotNull()).select(part, F.col("rows").alias("count"))


def cube_distribution(spark: SparkSession, cube: DataFrame, labels: Sequence[int] | None = None,
                      names: Sequence[str] | None = None) -> DataFrame:
    """A4: ``(label, name, count, pct)``; the percent is of all rows, null labels too."""
    every = Window.partitionBy()  # one row per label
    counts = cube.where("part = 'label'").select("label", F.col("rows").alias("count"),
                                                 (100.0 * F.col("rows") / F.sum("rows").over(every)).alias("pct"))
    named = counts.where("label is not null").join(F.broadcast(label_dimension(spark, labels, names)), "label", "left")
    return named.select("label", "name", "count", "pct")


def cube_values(cube: DataFrame, part: str) -> DataFrame:
    """A3: ``(value, count)`` by count, then value."""
    return _counts(cube, part).orderBy(F.desc("count"), F.asc(part))


def cube_top(cube: DataFrame, part: str, k: int = 20) -> DataFrame:
    """S-4: the ``k`` most frequent values, their rank and how many are left."""
    counts = _counts(cube, part)
    left = counts.agg(F.greatest(F.count(F.lit(1)) - k, F.lit(0)).alias("remaining"))
    top = counts.orderBy(F.desc("count"), F.asc(part)).limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("count"), F.asc(part)))  # k rows
    return top.select(part, "count", rank.alias("rank")).join(F.broadcast(left))  # one row


def cube_lengths(cube: DataFrame) -> DataFrame:
    """A7 over text lengths, exact: count, mean, std (sample), min, quartiles, max."""
    by = _counts(cube, "length")
    wide, n = F.col("length").cast("decimal(38,0)"), F.col("count")
    one = by.agg(F.sum(n).alias("count"), F.sum(wide * n).cast("double").alias("s"), F.sum(wide * wide * n).cast("double").alias("ss"),
                 F.min("length").cast("double").alias("min"), F.max("length").cast("double").alias("max"),
                 F.percentile("length", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), n).alias("q"))
    mean = F.col("s") / F.col("count")
    spread = F.sqrt(F.greatest((F.col("ss") - F.col("s") * mean) / F.nullif(F.col("count") - 1, F.lit(0)), F.lit(0.0)))
    return one.select(F.coalesce("count", F.lit(0)).alias("count"), mean.alias("mean"), F.when(F.col("count") > 1, spread).alias("std"), "min",
                      *(F.col("q")[i].alias(p) for i, p in enumerate(("p25", "p50", "p75"))), "max")


def cube_summary(cube: DataFrame) -> DataFrame:
    """The summary row: rows, classes, imbalance, languages, generators, lengths."""
    def of(part: str, value):
        return F.when((F.col("part") == part) & F.col(part).isNotNull(), value)

    rows, length = F.col("rows"), F.col("length")
    return cube.agg(F.sum(of("length", rows)).cast("bigint").alias("rows"),
                    (F.sum(of("length", length * rows)) / F.sum(of("length", rows))).alias("mean_length"),
                    F.min(of("length", length)).cast("bigint").alias("min_length"), F.max(of("length", length)).cast("bigint").alias("max_length"),
                    *(F.count(of(p, F.lit(1))).alias(f"n_{p}s") for p in ("language", "generator")),
                    F.count(of("label", F.lit(1))).alias("n_classes"),
                    (F.max(of("label", rows)) / F.min(of("label", rows))).alias("imbalance_ratio"))
