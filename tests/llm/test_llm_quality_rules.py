"""Quality rules against a plain computation, and their defined edge results."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelscope.llm import quality_rules as Q

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    cover = set()
    for i in range(len(words) - 4):
        if seen[tuple(words[i:i + 5])] > 1:
            cover |= set(range(i, i + 5))
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover),
            n < 10 or 100 * len(cover) > 20 * n)


EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "a b c d e " * 40), (6, "x\ny\nx\nx \n\nx"),
        (7, "ünï ##** <a|b> 日本 語 x \x0b y \x0c z q w e r t y"), (8, "word%d " * 3), (8, "word%d " * 3),
        (9, " ".join(f"w{i}" for i in range(60_000))), (10, "\n\n\nsame line here\nsame line here"), (None, "null id text")]


def test_base_counts_equal_a_plain_computation(spark):
    docs = spark.createDataFrame(EDGE, "doc_id long, text string").repartition(3)
    got = Q.judge(docs, None).collect()
    assert len(got) == len(EDGE)
    for r in got:
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == plain(r["text"])
        assert r["p_quality"] is None and r["kept"] == (not r["base_failed"])


def test_query_base_counts_on_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = Q.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = Q.judge(docs, model, carry=["doc_id"]).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == plain(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])


def test_held_out_accuracy_and_calibration(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    learn = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    rest = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)
    model = Q.fit(docs, learn, max_train=1200)
    judged = Q.judge(docs.join(rest, "doc_id"), model).where("not base_failed")
    r = judged.agg(F.avg(((F.col("p_quality") >= 0.5) == (F.col("quality") == 1)).cast("double")).alias("acc"),
                   F.avg("p_quality").alias("p"), F.avg(F.col("quality").cast("double")).alias("share")).first()
    assert r["acc"] > 0.97
    assert abs(r["p"] - r["share"]) < 0.05


def test_one_class_null_labels_and_empty_tables(spark):
    docs = spark.createDataFrame(EDGE, "doc_id long, text string")
    one = spark.createDataFrame([(4, 1), (5, 1), (None, None), (6, 7)], "doc_id long, quality int")
    assert Q.fit(docs, one) is None
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.fit(docs, none) is None
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert Q.judge(empty, None).count() == 0


def test_clashing_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", "x", 5)], "doc_id long, text string, kept string, y int")
    r = Q.judge(docs, None).first()
    assert r["kept"] is True and r["y"] == 5 and r["n_words"] == 11


@pytest.mark.parametrize("copies", [1, 3])
def test_partitioning_does_not_change_the_model(spark, copies):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(copies * 2)
    labels = spark.read.parquet(f"{SF}/labels.parquet").repartition(copies)
    m = Q.fit(docs, labels, max_train=200)
    n = Q.fit(docs.repartition(5), labels, max_train=200)
    assert (m.weights == n.weights).all() and (m.a, m.b) == (n.a, n.b)
