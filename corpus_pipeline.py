"""Corpus pipeline: five stages from raw documents to sampled training pieces.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``.

* ``quality``: documents whose perplexity exceeds their language's threshold go;
* ``near_duplicates``: of each group of linked documents the smallest id stays,
  and of rows that repeat an id and its text, one;
* ``substrings``: words of passages that occur earlier go; texts that lose
  nothing stay as they are, the others are their kept words (``n_chars`` follows);
* ``mixing``: every document is kept, and those of small sources are repeated as
  the temperature mix asks;
* ``pieces``: a sampled segmentation of every text, checked to decode to it.

Defined results: rows with null texts or languages pass the quality stage and
link with nothing; an empty table gives an empty result; other columns pass
through all but the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.llm import jaccard_tree, kneser_ney, mixing, piece_sampling, suffix_dedup
from labelscope.llm._io import stage_table, table, tidy_shuffles
from labelscope.llm.queries import MAX_REPETITION, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mark = docs.withColumn("__hash", F.xxhash64("text"))
    judged = kneser_ney.classify(mark, table(spark, sf_dir, "labels"), carry=["doc_id", "__hash"])
    rejected = judged.where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("__hash").alias("__h")).distinct()
    return mark.join(rejected, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")), "left_anti").drop("__hash")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tidy_shuffles(spark)
    keyed = docs.withColumn("__key", jaccard_tree.row_key("doc_id", "text"))  # rows without id have one too
    groups = jaccard_tree.key_components(keyed, "__key", "text")
    kept = groups.where(F.col("__key") == F.col("component_id")).select(F.col("__key").alias("__id")).distinct()
    found = keyed.join(kept, F.col("__key") == F.col("__id"), "left_semi").drop("__key")
    return found.withColumn("__hash", F.xxhash64("text")).dropDuplicates(["doc_id", "__hash"]).drop("__hash")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    found = suffix_dedup.remove_repeats(docs, carry=[*rest, "n_chars"], untouched=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.withColumn("n_chars", n_chars).withColumnRenamed("kept_text", "text").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mix = mixing.temperature_mix(docs, max_repetition=MAX_REPETITION)
    return mixing.realise(docs, mix).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = piece_sampling.sample_encode(docs, vocabulary("piece_bpe_32k.model"), carry=["doc_id", "lang", "source"])
    return rows.select("doc_id", "lang", "source", F.size("piece_ids").alias("n_pieces"), "piece_ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings),
          ("mixing", mix_sources), ("pieces", pieces)]

#: SQL can express neither the language model nor the sampled segmentations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
