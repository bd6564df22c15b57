"""Role tables: how the driver's tables play the reference's inputs.

scores   := embeddings   key vec_id, y_true = label (10 classes),
                         logits = first 10 dims as array<double>, y_pred = argmax
scores_b := embeddings   second head: argmax of dims 11..20 (agreement input)
corpus   := documents    key doc_id, code = text, language = lang,
                         generator = source, label = en 0, de 1, es 2, fr 3
judged   := documents x labels  y_true = quality, y_pred = n_chars >= 1000
history  := events       one row per day (epoch), val_f1 = avg(value) / 100
skewed   := orders       key o_orderkey, class 0 = o_orderkey % 25 < 22 (88 %),
                         classes 1-3 = o_orderkey % 25 - 21
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelscope.functions.arrays import argmax
from labelscope.sources.io import read_table

SCORE_CLASSES = list(range(10))
SKEWED_CLASSES = [0, 1, 2, 3]
CORPUS_LANGS = ["en", "de", "es", "fr"]  # fixed values: class 0..3 of the corpus role


def table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", columns)


def _logits(first: int, n: int = 10):
    return F.transform(F.slice("embedding", first, n), lambda x: x.cast("double"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings", ["vec_id", "label", "embedding"])
    return (e.select("vec_id", F.col("label").cast("int").alias("y_true"), _logits(1).alias("logits"))
            .withColumn("y_pred", argmax("logits")))


def scores_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return e.select("vec_id", argmax(_logits(11)).alias("y_pred"))


def corpus(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    cols = ["doc_id", "lang", "source"] + (["text"] if with_text else [])
    d = table(spark, sf_dir, "documents", cols)
    label = F.lit(None).cast("int")
    for i, lang in reversed(list(enumerate(CORPUS_LANGS))):
        label = F.when(F.col("lang") == lang, F.lit(i)).otherwise(label)
    out = [F.col("doc_id"), F.col("lang").alias("language"), F.col("source").alias("generator"),
           label.cast("int").alias("label")]
    if with_text:
        out.append(F.col("text").alias("code"))
    return d.select(*out)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", ["doc_id", "lang", "source", "n_chars"])
    lab = table(spark, sf_dir, "labels", ["doc_id", "quality"])
    # no hint: both sides grow with the data, AQE picks the strategy from runtime sizes
    return d.join(lab, "doc_id").select(
        "doc_id", F.col("lang").alias("language"), F.col("source").alias("generator"),
        F.col("quality").cast("int").alias("y_true"),
        (F.col("n_chars") >= 1000).cast("int").alias("y_pred"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", ["ts", "value"])
    daily = ev.groupBy(F.to_date("ts").alias("day")).agg(
        (F.min("value") / 100).alias("train_loss"), (F.max("value") / 1000).alias("train_f1"),
        (F.avg("value") / 100).alias("val_f1"))
    # one row per day: the epoch numbering window runs over a days-sized table
    return daily.select(F.row_number().over(Window.orderBy("day")).cast("int").alias("epoch"),
                        "train_loss", "train_f1", "val_f1")


def skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", ["o_orderkey"])
    m = F.col("o_orderkey") % 25
    return o.select("o_orderkey", F.when(m < 22, F.lit(0)).otherwise(m - 21).cast("int").alias("label"))
