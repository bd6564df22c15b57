"""A table stored in sample order, so that samples read about their own rows.

Rows are written sorted by class and seeded key (the key of the sampling
operators), in small row groups, beside a table of row counts by class and key
bucket. The first ``n`` rows of a class are those below the end of the bucket
that reaches ``n``; this bound goes to the Parquet scan as a filter on two sorted
columns, whose row-group and page statistics leave the other rows unread. The sample
itself is made by ``sample_by_class`` from what was read, so it is the same as
from the whole table.

The counts table has at most 16**5 rows a class; the driver reads one row a class.
Rows without a class are stored, but in no sample, as in ``sample_by_class``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelscope.functions.hashing import bucket_of, seeded_key
from labelscope.operators import sampling

DIGITS = 5
#: Bytes of a row group: a bound reads one more of them than the sample needs.
ROW_GROUP_BYTES = 4 << 20
KEY = "_sample_key"


def write_layout(df: DataFrame, path: str, *, seed=42, id_cols: Sequence[str] = ("id",), label_col: str = "label",
                 row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Store ``df`` under ``path``: ``rows``, ``counts`` and ``meta``."""
    if KEY in df.columns:
        raise ValueError(f"a column is named {KEY}")
    keyed = df.withColumn(KEY, seeded_key(seed, *id_cols))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = keyed.repartitionByRange(parts, label_col, KEY).sortWithinPartitions(label_col, KEY)
    rows.write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(f"{path}/rows")
    stored = df.sparkSession.read.parquet(f"{path}/rows").where(F.col(label_col).isNotNull())
    counts = stored.groupBy(F.col(label_col).alias("label"), bucket_of(KEY, DIGITS).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    counts.write.mode("overwrite").parquet(f"{path}/counts")
    meta = json.dumps({"seed": seed, "id_cols": list(id_cols), "label_col": label_col})
    df.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def _bounds(counts: DataFrame, n: int) -> dict:
    """For each class the bucket that holds its ``n``-th row, or None when it has
    no more than ``n``."""
    upto = Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = counts.withColumn("upto", F.sum("rows").over(upto))
    per = summed.groupBy("label").agg(F.min(F.when(F.col("upto") >= n, F.col("bucket"))).alias("bucket"))
    return {r["label"]: r["bucket"] for r in per.collect()}


def read_first(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Rows that hold the first ``n`` rows of every class in key order, and few others."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    rows = spark.read.parquet(f"{path}/rows")
    label = F.col(meta["label_col"])
    wanted: list[Column] = []
    for value, bucket in _bounds(spark.read.parquet(f"{path}/counts"), int(n)).items():
        below = F.lit(True) if bucket is None or bucket + 1 == 16 ** DIGITS else F.col(KEY) < F.lit(f"{bucket + 1:0{DIGITS}x}")
        wanted.append((label == F.lit(value)) & below)
    return rows.where(reduce(lambda a, b: a | b, wanted, F.lit(False)))


def sample_layout(spark: SparkSession, path: str, samples_per_class: int, labels: Sequence[int] | None = None,
                  shuffle: bool = False) -> DataFrame:
    """R9 from a stored layout: the sample that ``sample_by_class`` takes from the whole table."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    rows = read_first(spark, path, samples_per_class).drop(KEY)
    return sampling.sample_by_class(spark, rows, samples_per_class, seed=meta["seed"], id_cols=meta["id_cols"],
                                    label_col=meta["label_col"], labels=labels, shuffle=shuffle)
