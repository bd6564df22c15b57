"""Registered queries of the subpackage: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.llm import (cross_align, hnsw, jaccard_tree, kneser_ney, mixing, oracle, periodic_runs, piece_sampling, quality_rules,
                            rp_forest, suffix_dedup, token_counts, url_filter, warc)
from labelscope.llm._io import table

#: Rules of the URL query: (action, host, path).
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Host words of the sites whose pages make up the URL list.
LISTED_HOSTS = r"(^|[.-])(adult|bets|casino|spam)([.-]|$)"
#: Times that the mixing query lets a source be read, at most.
MAX_REPETITION = 1.5


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.round_trip(spark, pages, "page_id", "url", "html").withColumnRenamed("id", "page_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, model, carry=["doc_id"])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return suffix_dedup.remove_repeats(docs, carry=["doc_id"], digest=True)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.select("url").where(url_filter.host(F.col("url")).rlike(LISTED_HOSTS))
    return url_filter.filter_urls(pages, listed, URL_RULES, carry=["page_id"])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.temperature_mix(table(spark, sf_dir, "documents"), max_repetition=MAX_REPETITION)
    return mix.copies(mix.sized.select(F.col("id").alias("doc_id"), "source", "n_tokens"), "source", "doc_id")


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"),
                                     limit=1024, carry=["doc_id"])


def op9_jaccard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_tree.near_components(table(spark, sf_dir, "documents"))


def op10_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.sample_digest(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"),
                                        carry=["doc_id"])


def op11_cross_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_align.align_tokenizers(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"),
                                        vocabulary("piece_bpe_32k.model"), carry=["doc_id"], digest=True)


def op12_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return rp_forest.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic_runs.loop_tails("doc_id", "text").alias("text"))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(docs, carry=["doc_id"]), ["doc_id"])


QUERIES = {f.__name__: f for f in (
    op1_warc, op2_quality_rules, op3_suffix_dedup, op4_url_filter, op5_mixing, op6_kneser_ney, op7_hnsw,
    op8_token_counts, op9_jaccard_tree, op10_piece_sampling, op11_cross_align, op12_rp_forest,
    op13_periodic_runs)}

#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = oracle.ORACLE
