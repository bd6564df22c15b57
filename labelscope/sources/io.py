"""Sources and sinks (IO1-IO9, IO11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """IO1: Parquet; selecting columns here lets Catalyst prune the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
             schema: str | T.StructType | None = None) -> DataFrame:
    """IO2: CSV with header, columns taken by name. With ``columns`` they are read
    as strings (what the submission check needs to judge types itself), with
    ``schema`` cast; a missing column or a value that does not cast raises."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if schema is not None:
        want = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    elif columns is not None:
        want = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    else:
        return df
    missing = [f.name for f in want if f.name not in df.columns]
    if missing:
        raise ValueError(f"{path} has no column {missing}; it has {df.columns}")

    def typed(f: T.StructField):
        raw = F.col(f"`{f.name}`")
        got = raw.try_cast(f.dataType)
        bad = F.raise_error(F.concat(F.lit(f"{f.name} is not {f.dataType.simpleString()}: "), raw)).cast(f.dataType)
        return F.when(raw.isNotNull() & got.isNull(), bad).otherwise(got).alias(f.name)

    return df.select(*(F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType) else typed(f) for f in want))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """IO3: a JSON file holding one top-level array of epoch records."""
    return spark.read.option("multiLine", True).json(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] | None = None) -> None:
    """IO4: Parquet, overwrite."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, order_by: Sequence[str] | None = None,
              single_file: bool = False) -> None:
    """IO5/IO6: CSV with header, no index. ``order_by`` range-partitions and
    sorts, so the part files concatenate in key order (no single-task sort).
    ``single_file`` is for outputs bounded by the number of classes or groups:
    the sorted partitions are concatenated in order into one file."""
    if order_by:
        df = df.orderBy(*order_by)
    if single_file:
        df = df.coalesce(1)
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, single_file: bool = False) -> None:
    """IO7/IO8: JSON lines."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").json(path)


def write_history(history: DataFrame, path: str, order_col: str = "epoch") -> None:
    """IO8: the history as one top-level JSON array of epoch records (what
    ``read_history`` reads). One row per epoch or candidate: a small table,
    gathered into one array value in one task."""
    cols = [F.col(c) for c in history.columns]
    one = history.agg(F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("_order"),
                                                           F.struct(*cols).alias("_rec")))).alias("_all"))
    arr = F.transform(F.col("_all"), lambda x: x["_rec"])
    one.select(F.to_json(arr).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_text(lines: DataFrame, path: str, order_col: str | None = None,
               value_col: str = "value", single_file: bool = False) -> None:
    """IO9: one formatted line per row."""
    if order_col:
        lines = lines.orderBy(order_col)
    if single_file:
        lines = lines.coalesce(1)
    lines.select(F.col(value_col).alias("value")).write.mode("overwrite").text(path)


def has_column(df: DataFrame, name: str) -> bool:
    """IO11: case-sensitive column test."""
    return name in df.columns
