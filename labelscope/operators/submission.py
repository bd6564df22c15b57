"""Prediction / submission tables and their validation.

The validation runs as one scan aggregate (V2, V3, V4, V6) plus one group-by
on ``id`` (V5), and reports every check as a row ``(check_id, check, passed,
bad_rows)``; ``first_failure`` gives the reference's stop-at-first answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.operators.ranking import row_ids
from labelscope.sources.io import has_column

# the integer pattern a CSV column must match to be integer typed
INT_PATTERN = "^[+-]?[0-9]+$"
VALID_LABELS = list(range(11))


def resolve_id(df: DataFrame, order_col: str | None = None, out: str = "ID") -> DataFrame:
    """``ID`` if present, else ``id``, else the row position (R4) over
    ``order_col`` (mandatory then: a distributed table has no implicit order)."""
    if "ID" in df.columns:
        return df.withColumn(out, F.col("ID").cast("bigint")) if out != "ID" else df
    if "id" in df.columns:
        return df.withColumn(out, F.col("id").cast("bigint"))
    if order_col is None:
        raise ValueError("no ID/id column: pass order_col to number rows")
    return row_ids(df, order_col, out=out)


def predictions_table(scored: DataFrame, order_col: str, pred_col: str = "y_pred") -> DataFrame:
    """(id, label) with id the 0-based position in ``order_col`` order."""
    return row_ids(scored, order_col, out="id").select(
        F.col("id").cast("bigint").alias("id"), F.col(pred_col).cast("int").alias("label"))


def submission_table(test: DataFrame, predictions: DataFrame, order_col: str) -> DataFrame:
    """Test IDs joined to predictions by position: the test table's rows
    are numbered in ``order_col`` order (also when it has an ID column, which
    need not follow that order) and meet the predictions' 0-based ``id``. Rows
    of either side without a partner, and repeated prediction ids, raise.
    Output (ID, label)."""
    pos = row_ids(test, order_col, out="_pos")
    pos = pos.withColumn("ID", F.col("_pos")) if not {"ID", "id"} & set(test.columns) else resolve_id(pos, out="ID")
    p = predictions.groupBy(F.col("id").alias("_pos")).agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("_n"))
    both = pos.select("_pos", F.col("ID").cast("bigint").alias("ID"), F.lit(True).alias("_in_test")).join(p, "_pos", "full_outer")

    def fail(text: str):
        return F.raise_error(F.concat(F.lit(text), F.col("_pos").cast("string"))).cast("bigint")

    checked = (F.when(F.col("_in_test").isNull(), fail("prediction without a test row: "))
               .when(F.col("_n").isNull(), fail("test row without a prediction: "))
               .when(F.col("_n") > 1, fail("repeated prediction id: ")).otherwise(F.col("ID")))
    return both.select(checked.alias("ID"), F.col("label").cast("int").alias("label"))


def _is_int(c):
    s = F.col(c).cast("string")
    return s.isNotNull() & s.rlike(INT_PATTERN) & s.try_cast("bigint").isNotNull()


def submission_checks(spark: SparkSession, df: DataFrame,
                      valid_labels: Sequence[int] = VALID_LABELS) -> DataFrame:
    """V1-V6 as rows (check_id, check, passed, bad_rows). ``df`` is the table as
    read with every column as string (IO2), so type checks see raw text."""
    has_cols = has_column(df, "id") and has_column(df, "label")
    if not has_cols:  # V1 fails: nothing else is meaningful
        return spark.createDataFrame(
            [(1, "columns", False, 0)], "check_id INT, check STRING, passed BOOLEAN, bad_rows BIGINT")
    lab = F.col("label").cast("string")
    lab_int = lab.try_cast("bigint")
    any_null = F.lit(False)
    for c in df.columns:
        any_null = any_null | F.col(c).isNull()
    # one pass: the V5 group-by on id also carries the per-id counts of bad
    # rows (partial aggregation before the shuffle), then one global sum
    # 1, 01 and +1 are the same integer id
    number = F.coalesce(F.col("id").cast("string").try_cast("bigint").cast("string"), F.col("id").cast("string"))
    per_id = df.groupBy(number.alias("_id")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(~F.coalesce(_is_int("id"), F.lit(False))).alias("_bad_id"),
        F.count_if(~F.coalesce(_is_int("label"), F.lit(False))).alias("_bad_label"),
        F.count_if(lab_int.isNotNull() & ~lab_int.isin([int(x) for x in valid_labels])).alias("_invalid"),
        F.count_if(any_null).alias("_nulls"))
    one = per_id.agg(
        F.coalesce(F.sum("_bad_id"), F.lit(0)).alias("bad_id"),
        F.coalesce(F.sum("_bad_label"), F.lit(0)).alias("bad_label"),
        F.coalesce(F.sum("_invalid"), F.lit(0)).alias("invalid"),
        F.coalesce(F.sum("_nulls"), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("dups"))
    dups = F.col("dups")
    rows = one.select(F.explode(F.array(
        F.struct(F.lit(1).alias("check_id"), F.lit("columns").alias("check"),
                 F.lit(0).cast("bigint").alias("bad_rows")),
        *[F.struct(F.lit(i).alias("check_id"), F.lit(name).alias("check"),
                   c.cast("bigint").alias("bad_rows"))
          for i, name, c in [(2, "id_integer", F.col("bad_id")), (3, "label_integer", F.col("bad_label")),
                             (4, "label_range", F.col("invalid")), (5, "unique_id", dups),
                             (6, "no_missing", F.col("nulls"))]])).alias("r")).select("r.*")
    return rows.select("check_id", "check", (F.col("bad_rows") == 0).alias("passed"), "bad_rows")


def first_failure(checks: DataFrame) -> DataFrame:
    """The reference stops at the first failing check: that row, or none."""
    return checks.where(~F.col("passed")).orderBy("check_id").limit(1)


def preview(df: DataFrame, order_col: str = "ID", n: int = 10) -> DataFrame:
    """S-5: the first ``n`` rows in ``order_col`` order (a top-n: TakeOrderedAndProject)."""
    return df.orderBy(order_col).limit(int(n))


def invalid_labels(spark: SparkSession, df: DataFrame, label_col: str = "label",
                   valid_labels: Sequence[int] = VALID_LABELS) -> DataFrame:
    """Distinct labels outside the valid set (left anti join to the dimension)."""
    dim = spark.createDataFrame([(int(x),) for x in valid_labels], "label BIGINT")
    seen = df.select(F.col(label_col).cast("bigint").alias("label")).where(
        F.col("label").isNotNull()).distinct()
    return seen.join(F.broadcast(dim), "label", "left_anti")


def duplicate_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """V5: ids that occur more than once, with their multiplicity."""
    return (df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))


def submission_summary(df: DataFrame, label_col: str = "label") -> DataFrame:
    """V7: total and label distribution with percent (total: a window over the
    <= one row per label of the count aggregate)."""
    from pyspark.sql import Window

    total = F.sum("count").over(Window.partitionBy())
    return (df.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("count"))
            .withColumn("pct", 100.0 * F.col("count") / total).withColumn("total", total))
