"""Label dimension (P4, J6) and the K x K grid for confusion matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Class names of the reference task, label 0 to 10, in order.
LABEL_NAMES = [
    "Human", "DeepSeek-AI", "Qwen", "01-ai", "BigCode", "Gemma",
    "Phi", "Meta-LLaMA", "IBM-Granite", "Mistral", "OpenAI",
]


def label_dimension(spark: SparkSession, labels: Sequence[int] | None = None,
                    names: Sequence[str] | None = None) -> DataFrame:
    """(label INT, name STRING): a tiny table, safe to broadcast (<= len(labels) rows)."""
    if labels is None:
        labels = list(range(len(LABEL_NAMES)))
    if names is None:
        names = [LABEL_NAMES[i] if 0 <= i < len(LABEL_NAMES) else str(i) for i in labels]
    rows = [(int(lab), str(n)) for lab, n in zip(labels, names)]
    return spark.createDataFrame(rows, "label INT, name STRING")


def label_grid(spark: SparkSession, labels: Sequence[int],
               left: str = "y_true", right: str = "y_pred") -> DataFrame:
    """All K*K (left, right) pairs, generated from one range, no join."""
    k = len(labels)
    arr = F.array(*[F.lit(int(x)) for x in labels])
    return (spark.range(k * k)
            .select(F.element_at(arr, (F.col("id") / k).cast("int") + 1).alias(left),
                    F.element_at(arr, (F.col("id") % k).cast("int") + 1).alias(right)))


def attach_names(spark: SparkSession, df: DataFrame, label_col: str = "label",
                 labels: Sequence[int] | None = None, names: Sequence[str] | None = None,
                 unknown: str = "raise", out: str = "name") -> DataFrame:
    """Label -> name by a broadcast join to the (<= len(labels) rows)
    dimension. A label outside it raises (the reference's failing dict
    lookup) or, with ``unknown="null"``, keeps a null name."""
    dim = label_dimension(spark, labels, names).select(
        F.col("label").alias("_dim_label"), F.col("name").alias("_dim_name"))
    j = df.join(F.broadcast(dim), F.col(label_col) == F.col("_dim_label"), "left")
    name = F.col("_dim_name")
    if unknown == "raise":
        name = F.when(F.col(label_col).isNull() | F.col("_dim_name").isNotNull(), name).otherwise(
            F.raise_error(F.concat(F.lit("unknown label "), F.col(label_col).cast("string"))))
    return j.withColumn(out, name).drop("_dim_label", "_dim_name")
