"""Row positions of files, and tables aligned by position.

The reference pairs tables by row position. A Parquet file knows the place of
each row (``_metadata.row_index``), so a table read from files needs neither an
order column nor a sort: files are ordered by path, each file's rows are
counted, and a row's position is the rows of the files before its own plus its
place in it. Part files of one write are ordered by their number, which is the
order of the partitions that wrote them.

Only the file list (a row per file) is summed up in one window; the data rows
are read once, without a shuffle, and joined to the list by file name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelscope.operators.ranking import bounded_broadcast

#: Files whose offsets may be broadcast.
BROADCAST_FILES = 100_000


def file_offsets(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(file, rows, offset)`` of every file with rows, in path order."""
    paths = [path] if isinstance(path, str) else list(path)
    files = spark.read.parquet(*paths).select("_metadata.file_path").groupBy(F.col("file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.select("file", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))


def read_positions(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None,
                   out: str = "position") -> DataFrame:
    """The table at ``path`` with its rows' positions from 0, without gaps."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    columns = list(df.columns if columns is None else columns)
    rows = df.select(F.struct(*columns).alias("_row"), F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.row_index").alias("_place"))
    offsets = file_offsets(spark, path)
    files = len(df.inputFiles())
    placed = rows.join(bounded_broadcast(offsets, files) if files <= BROADCAST_FILES else offsets, "file")
    return placed.select((F.col("offset") + F.col("_place")).alias(out), *(F.col("_row")[c].alias(c) for c in columns))


def align_positions(left: DataFrame, right: DataFrame, position: str = "position") -> DataFrame:
    """Rows of both tables side by side by position; a row of either table
    without a partner (unequal lengths) raises, as do repeated positions.
    Columns of both tables must have different names."""
    both = set(left.columns) & set(right.columns) - {position}
    if both:
        raise ValueError(f"both tables have columns {sorted(both)}")
    a = left.select(F.col(position).alias("_at"), F.struct(*(c for c in left.columns if c != position)).alias("_a"))
    b = right.select(F.col(position).alias("_at"), F.struct(*(c for c in right.columns if c != position)).alias("_b"))
    # grouped instead of joined: repeated positions show as counts, not as products
    side = a.select("_at", "_a", F.lit(None).cast(b.schema["_b"].dataType).alias("_b")).unionByName(
        b.select("_at", F.lit(None).cast(a.schema["_a"].dataType).alias("_a"), "_b"))
    met = side.groupBy("_at").agg(F.first("_a", True).alias("_a"), F.first("_b", True).alias("_b"),
                                  F.count("_a").alias("_na"), F.count("_b").alias("_nb"))

    def fail(text: str):
        return F.raise_error(F.concat(F.lit(text), F.coalesce(F.col("_at").cast("string"), F.lit("null")))).cast("bigint")

    checked = (F.when(F.col("_na") == 0, fail("only the right table has a row at position "))
               .when(F.col("_nb") == 0, fail("only the left table has a row at position "))
               .when((F.col("_na") > 1) | (F.col("_nb") > 1) | F.col("_at").isNull(), fail("not one row at position "))
               .otherwise(F.col("_at")))
    return met.select(checked.alias(position), *(F.col("_a")[c].alias(c) for c in left.columns if c != position),
                      *(F.col("_b")[c].alias(c) for c in right.columns if c != position))
