"""Classification metrics.

Every metric derives from one aggregate: ``pair_counts`` =
``groupBy(y_true, y_pred).count()``, a partial + final hash aggregate whose
output has at most K^2 rows whatever the input size. Per-class support,
predicted counts and true positives come from exploding each pair row into
its two class roles and one more group-by over those <= 2K^2 rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelscope.functions.arrays import argmax
from labelscope.functions.labels import LABEL_NAMES, label_dimension, label_grid


def predict_argmax(df: DataFrame, logits_col: str = "logits", out: str = "y_pred") -> DataFrame:
    """M9: index of the largest logit (lowest index on a tie)."""
    return df.withColumn(out, argmax(logits_col))


def pair_counts(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", nulls: str = "raise") -> DataFrame:
    """(y_true, y_pred, n). A row with a missing side raises, as every metric
    would leave it out unseen; ``nulls="drop"`` leaves such rows out."""
    if nulls not in ("raise", "drop"):
        raise ValueError("nulls is 'raise' or 'drop'")

    def side(c: str):
        if nulls == "drop":
            return F.col(c).cast("int")
        return F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null {c}: metrics need both sides")).cast("int")).otherwise(F.col(c).cast("int"))

    src = df.where(F.col(y_true).isNotNull() & F.col(y_pred).isNotNull()) if nulls == "drop" else df
    return (src.select(side(y_true).alias("y_true"), side(y_pred).alias("y_pred"))
            .groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n")))


def confusion_matrix(spark: SparkSession, pairs: DataFrame, labels: Sequence[int]) -> DataFrame:
    """M1, long form (y_true, y_pred, n): the full K x K grid, 0 where absent;
    pairs with a label outside ``labels`` are dropped."""
    grid = label_grid(spark, labels)
    return (grid.join(F.broadcast(pairs.where(F.col("y_true").isin(list(labels))
                                              & F.col("y_pred").isin(list(labels)))),
                      ["y_true", "y_pred"], "left")
            .select("y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def confusion_wide(spark: SparkSession, pairs: DataFrame, labels: Sequence[int]) -> DataFrame:
    """M1, wide form: one row per true class, one column per predicted class."""
    long = confusion_matrix(spark, pairs, labels)
    return (long.groupBy("y_true").pivot("y_pred", list(labels)).agg(F.sum("n"))
            .orderBy("y_true"))


def confusion_normalized(spark: SparkSession, pairs: DataFrame, labels: Sequence[int]) -> DataFrame:
    """M2: cell / row sum; an empty true row gives null."""
    long = confusion_matrix(spark, pairs, labels)
    row_sum = F.sum("n").over(Window.partitionBy("y_true"))
    return long.withColumn("share", F.try_divide(F.col("n").cast("double"), row_sum))


def class_roles(pairs: DataFrame) -> DataFrame:
    """(label, support, predicted, tp) for every label seen on either side."""
    roles = F.explode(F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).cast("bigint").alias("tp")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp"))))
    return (pairs.select(roles.alias("r")).select("r.*").groupBy("label")
            .agg(F.sum("support").cast("bigint").alias("support"),
                 F.sum("predicted").cast("bigint").alias("predicted"),
                 F.sum("tp").cast("bigint").alias("tp")))


def _prf(df: DataFrame) -> DataFrame:
    """precision, recall, f1 with zero division = 0."""
    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return (df.withColumn("precision", ratio(F.col("tp"), F.col("predicted")))
            .withColumn("recall", ratio(F.col("tp"), F.col("support")))
            .withColumn("f1", ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))))


def per_class(spark: SparkSession, pairs: DataFrame, labels: Sequence[int] | None = None) -> DataFrame:
    """M3: (label, precision, recall, f1, support, predicted, tp).

    With ``labels``, dense over that list (absent classes are all zero);
    without, one row per class present in true or predicted."""
    roles = class_roles(pairs)
    if labels is not None:
        dim = spark.createDataFrame([(int(x),) for x in labels], "label INT")
        roles = dim.join(F.broadcast(roles.where(F.col("label").isin(list(labels)))), "label", "left").select(
            "label", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
                       for c in ("support", "predicted", "tp")])
    return _prf(roles)


def macro_f1(pairs: DataFrame) -> DataFrame:
    """M4: mean F1 over classes present in y_true or y_pred."""
    return _prf(class_roles(pairs)).agg(F.avg("f1").alias("macro_f1"))


def macro_f1_fixed(spark: SparkSession, pairs: DataFrame, labels: Sequence[int]) -> DataFrame:
    """M5: mean F1 over a fixed label list, absent classes counting 0."""
    return per_class(spark, pairs, labels).agg(F.avg("f1").alias("macro_f1"))


def accuracy(pairs: DataFrame) -> DataFrame:
    """M7: share of rows with y_true == y_pred."""
    return pairs.agg((F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
                      / F.sum("n")).alias("accuracy"))


def metrics_record(pairs: DataFrame) -> DataFrame:
    """M8: one row (macro_f1, accuracy), one aggregate over the class roles:
    their supports sum to the row count and their true positives to the hits."""
    return _prf(class_roles(pairs)).agg(
        F.avg("f1").alias("macro_f1"),
        (F.sum("tp").cast("double") / F.sum("support")).alias("accuracy"))


def classification_report(spark: SparkSession, pairs: DataFrame, labels: Sequence[int],
                          names: Sequence[str] | None = None, digits: int = 3,
                          strict: bool = False) -> DataFrame:
    """M6: per-class rows + accuracy, macro avg and weighted avg rows.

    Columns: (row_order, name, precision, recall, f1_score, support), values
    rounded half-even to ``digits``. ``strict`` raises when the classes
    present are not exactly the names given (S11).

    One derivation of the pair counts: accuracy totals are windows over the
    class roles (all classes seen), the averages windows over the dense
    per-class rows (<= K rows), and the first class's row also emits the
    three summary rows, so no branch re-reads the input."""
    if names is None:
        names = [LABEL_NAMES[i] if 0 <= i < len(LABEL_NAMES) else str(i) for i in labels]
    labels = [int(x) for x in labels]
    every = Window.partitionBy()  # windows below run over <= K rows
    roles = (class_roles(pairs)
             .withColumn("_total", F.sum("support").over(every))
             .withColumn("_correct", F.sum("tp").over(every))
             .withColumn("_present", F.count(F.lit(1)).over(every)))
    dim = label_dimension(spark, labels, names)
    pc = _prf(dim.join(F.broadcast(roles.where(F.col("label").isin(labels))), "label", "left").select(
        "label", "name", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
                           for c in ("support", "predicted", "tp")],
        "_total", "_correct", "_present"))
    if strict:
        pc = pc.withColumn("_chk", F.when(F.max("_present").over(every) == len(labels), F.lit(True))
                           .otherwise(F.raise_error(F.lit("number of classes present does not match "
                                                          "target names")))).where(F.col("_chk"))
    total = F.max("_total").over(every)
    s = F.sum("support").over(every)
    pc = pc.select(
        "label", "name", "precision", "recall", "f1", "support",
        total.alias("_t"), (F.max("_correct").over(every) / total).alias("_acc"),
        F.avg("precision").over(every).alias("_mp"), F.avg("recall").over(every).alias("_mr"),
        F.avg("f1").over(every).alias("_mf"), s.alias("_s"),
        (F.sum(F.col("precision") * F.col("support")).over(every) / s).alias("_wp"),
        (F.sum(F.col("recall") * F.col("support")).over(every) / s).alias("_wr"),
        (F.sum(F.col("f1") * F.col("support")).over(every) / s).alias("_wf"))
    n = len(labels)

    def row(order, name, p, r, f, sup):
        return F.struct(order.cast("int").alias("row_order"), name.alias("name"),
                        p.cast("double").alias("precision"), r.cast("double").alias("recall"),
                        f.cast("double").alias("f1_score"), sup.cast("bigint").alias("support"))

    own = row(F.col("label"), F.col("name"), F.col("precision"), F.col("recall"), F.col("f1"),
              F.col("support"))
    null = F.lit(None)
    summary = [row(F.lit(n), F.lit("accuracy"), null, null, F.col("_acc"), F.col("_t")),
               row(F.lit(n + 1), F.lit("macro avg"), F.col("_mp"), F.col("_mr"), F.col("_mf"), F.col("_s")),
               row(F.lit(n + 2), F.lit("weighted avg"), F.col("_wp"), F.col("_wr"), F.col("_wf"), F.col("_s"))]
    rows = F.when(F.col("label") == labels[0], F.array(own, *summary)).otherwise(F.array(own))
    out = pc.select(F.explode(rows).alias("r")).select("r.*")
    return out.select("row_order", "name",
                      *[F.bround(c, digits).alias(c) for c in ("precision", "recall", "f1_score")],
                      "support")


# The columns of the printed classification report.
REPORT_COLUMNS = ("precision", "recall", "f1-score", "support")


def report_text(report: DataFrame, digits: int = 3, width: int = 12) -> DataFrame:
    """IO9: the printed report, one line per row: header, blank, a line per class,
    blank, the three summary lines; ``row_order`` orders the lines. ``width`` is
    that of the longest name (at least 12, the width of "weighted avg")."""
    width = max(int(width), 12)
    text = lambda *c: F.format_string(f"%{width}s  %9s %9s %9s %9s", *c)
    number = lambda c: F.format_string(f"%9.{digits}f", c)
    summary = F.col("precision").isNull()
    blank = F.lit("")
    own = F.struct((2 * F.col("row_order")).alias("row_order"), text(
        F.col("name"), F.when(summary, blank).otherwise(number("precision")), F.when(summary, blank).otherwise(number("recall")),
        number("f1_score"), F.col("support").cast("string")).alias("value"))

    def line(order, value):
        return F.struct(order.cast("int").alias("row_order"), value.alias("value"))

    # the accuracy row, of which there is one, also brings the header and the blank lines
    head = [line(F.lit(-2), text(blank, *(F.lit(c) for c in REPORT_COLUMNS))), line(F.lit(-1), blank),
            line(2 * F.col("row_order") - 1, blank)]
    rows = F.when(summary, F.array(*head, own)).otherwise(F.array(own))
    return report.select(F.explode(rows).alias("r")).select("r.*")


def f1_series(spark: SparkSession, pairs: DataFrame, labels: Sequence[int],
              names: Sequence[str] | None = None) -> DataFrame:
    """Table behind the per-class F1 chart: label, name, f1, above_half (P10),
    and the fixed-K macro F1 line (M5, a window over the <= K class rows)."""
    if names is None:
        names = [LABEL_NAMES[i] if 0 <= i < len(LABEL_NAMES) else str(i) for i in labels]
    pc = per_class(spark, pairs, labels)
    return (pc.join(F.broadcast(label_dimension(spark, labels, names)), "label")
            .select("label", "name", "f1", (F.col("f1") > 0.5).alias("above_half"),
                    F.avg("f1").over(Window.partitionBy()).alias("macro_f1")))


def dense_distribution(spark: SparkSession, pairs: DataFrame, labels: Sequence[int]) -> DataFrame:
    """A5: true and predicted counts for every class in ``labels``, 0 where absent."""
    pc = per_class(spark, pairs, labels)
    return pc.select("label", F.col("support").alias("true_count"),
                     F.col("predicted").alias("pred_count"))
