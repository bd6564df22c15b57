"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from labelscope.llm import periodic_runs as P


def plain_runs(words):
    """All runs by their definition: every period, every maximal stretch."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j
    return sorted((s, m, q) for (s, m), q in found.items())


def plain_kept(words):
    drop = {i for s, m, q in plain_runs(words) for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in P.periodic_runs(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = words_of(t)
        assert [tuple(r) for r in got[i]["runs"]] == plain_runs(w), t
        assert got[i]["n_words"] == len(w) and got[i]["kept_text"] == plain_kept(w)


def test_random_words_of_few_letters(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab" if k % 2 else "abc") for _ in range(rng.randrange(0, 70))) for k in range(400)]
    check(spark, texts)


def test_planted_loops_nested_and_neighbouring(spark):
    rng = random.Random(5)

    def loop(p, m):
        w = [f"w{rng.randrange(6)}" for _ in range(p)]
        return [w[i % p] for i in range(m)]

    texts = []
    for p in (1, 2, 3, 5, 8, 13, 16, 17, 31, 32, 33):
        for m in (4 * p - 1, 4 * p, 4 * p + 1, 7 * p + 2):
            texts.append(" ".join(["x", *loop(p, m), "y", *loop(rng.randrange(1, 6), 40)]))
    inner = loop(2, 12)
    texts.append(" ".join((inner + ["z"]) * 6))  # runs inside the blocks of a run
    check(spark, texts)


def test_edges_of_texts(spark):
    check(spark, [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a a a a a a b", "a\x0ba\x0ca\x0da\ta\na", "ä ä ä ä ä ä", "a b " * 3, "a b " * 4])


def test_documents_do_not_run_into_each_other():
    first = np.array([0, 3, 3, 9])
    assert P.find_runs(np.zeros(9, np.int64), first).tolist() == [[2, 0, 6, 1]]


def test_long_text_in_one_loop(spark):
    w = [f"v{i}" for i in range(5000)] * 5
    df = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    r = P.periodic_runs(df).first()
    assert [tuple(x) for x in r["runs"]] == [(0, 25000, 5000)] and r["kept_text"] == " ".join(w[:5000])


def test_rows_without_id_repeats_extra_columns_and_empty_table(spark):
    rows = [(None, "a a a a a a", 1, "x"), (None, "b", 2, "y"), (3, "b", 3, "z"), (3, "b", 4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words long, __text string")
    got = P.periodic_runs(df)
    assert got.columns == ["doc_id", "text", "__text", "n_words", "runs", "kept_text"]
    assert sorted((r["__text"] or "", r["n_words"], r["kept_text"]) for r in got.collect()) == [("", 1, "b"), ("x", 6, "a"), ("y", 1, "b"), ("z", 1, "b")]
    assert P.run_digests(P.periodic_runs(df.where("n_words > 9")), ["doc_id"]).collect() == []
    looped = df.select("doc_id", P.loop_tails("doc_id", "text").alias("text"))
    assert sum(r["text"] == "a a a a a a" for r in looped.collect()) == 1


def test_less_than_four_times_is_refused():
    with pytest.raises(ValueError):
        P.find_runs(np.zeros(3, np.int64), np.array([0, 3]), times=3)


def test_digests_and_loops_by_hand(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 90)))) for i in range(300)] + [(300, None), (301, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    looped = df.select("doc_id", P.loop_tails("doc_id", "text").alias("text"))
    got = {r["doc_id"]: r for r in P.run_digests(P.periodic_runs(looped, carry=["doc_id"]), ["doc_id"]).collect()}
    loops = 0
    for i, t in rows:
        w = words_of(t)
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
            loops += 1
        runs, r = plain_runs(w), got[i]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None, None, None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_kept(w).encode()).hexdigest()
    assert loops > 10
