"""URL rules, canonical forms and the listed-URL filter."""

import pytest
from pyspark.sql import functions as F

from labelscope.llm import url_filter as U

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "com", "/de/"))


def rows(spark, urls, listed, rules=RULES):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    lists = spark.createDataFrame([(u,) for u in listed], "url string")
    return {r["page_id"]: r for r in U.filter_urls(pages, lists, rules).collect()}


def test_host_path_and_rules(spark):
    urls = ["HTTPS://WWW.Example.ORG/es/1?x#y", "http://a.example.org/ES/1", "no scheme", None, "", "x://h", "x://H?q=/de/", "ftp://b.com/de/#f",
            "http://notorg/es/", "http://u.com/q://z.org/es/", "http://example.org/es"]
    got = rows(spark, urls, [])
    seen = [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))]
    assert seen == [("www.example.org", "/es/1", "example.org/es/", "block"), ("a.example.org", "/ES/1", "org/", "allow"),
                    ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h", "", None, "allow"), ("h", "", None, "allow"),
                    ("b.com", "/de/", "com/de/", "block"), ("notorg", "/es/", None, "allow"), ("u.com", "/q://z.org/es/", None, "allow"),
                    ("example.org", "/es", "org/", "allow")]


def test_canonical_urls(spark):
    urls = ["http://www.A.net/x/?b=2&a=1&utm_source=q#top", "https://a.net/x?a=1&b=2&ref=z", "a://a.net/x//", "a://a.net/X", None, "q"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(U.canonical(F.col("u")).alias("c"))
    assert [r["c"] for r in df.collect()] == ["a.net/x?a=1&b=2", "a.net/x?a=1&b=2", "a.net/x", "a.net/X", "", ""]


def plain(urls, listed):
    return [u in listed for u in urls]


@pytest.mark.parametrize("tight", [False, True])
@pytest.mark.parametrize("shuffled", [False, True])
def test_false_positives_are_removed(spark, monkeypatch, tight, shuffled):
    """A filter so small that nearly everything passes, and both ways to reach it, give the same verdicts."""
    if tight:
        monkeypatch.setattr(U, "BITS_PER_URL", 1)
    if shuffled:
        monkeypatch.setattr(U, "BROADCAST_BYTES", 0)
    urls = [f"http://h{i % 50}.net/p{i % 700}" for i in range(2000)]
    listed = {u for i, u in enumerate(urls) if i % 3 == 0}
    got = rows(spark, urls, [*listed, None, "", "not a url"], ())
    assert [got[i]["verdict"] == "block" for i in range(2000)] == plain(urls, listed)


def test_filter_has_no_false_negatives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h.net/"), F.col("id").cast("string")).alias("canonical"))
    table = U.bloom_table(listed, 40)
    c = F.col("canonical")
    probe = listed.join(table, U._block(c, 40) == F.col("block"))
    every = F.lit(True)
    for i in range(U.WORDS):
        every = every & (F.col(f"w{i}").bitwiseAND(U._bit(c, i)) == U._bit(c, i))
    assert probe.where(every).count() == 3000


def test_empty_tables_repeats_and_clashing_columns(spark):
    assert rows(spark, [], ["http://a.net/"]) == {}
    pages = spark.createDataFrame([(1, "http://a.net/x", "p", 5), (1, "http://a.net/x", "p", 5)], "page_id long, url string, path string, w0 int").withColumn("block", F.lit("b"))
    lists = spark.createDataFrame([("https://www.a.net/x/",)], "url string")
    got = U.filter_urls(pages, lists).collect()
    assert [(r["path"], r["verdict"], r["w0"], r["block"]) for r in got] == [("/x", "block", 5, "b")] * 2
