"""Substring dedup against the plain definition."""

import hashlib
import random

import numpy as np
import pytest

from labelscope.llm import suffix_dedup as S


def plain(rows, window=20):
    seen, out = {}, []
    words = {}
    for i, text in rows:
        words.setdefault(i, (text or "").encode().split())
    for i in sorted(words):
        w = words[i]
        gone = set()
        for k in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[k:k + window]), (i, k)) != (i, k):
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out)


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = S.remove_spans(docs, S.repeat_spans(docs), digest=True)
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect())


def corpus(seed, n=60, vocabulary=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["é", "日本"]
    passages = [[rng.choice(words) for _ in range(rng.randint(18, 70))] for _ in range(6)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [rng.choice(words) for _ in range(rng.randint(0, 60))] if rng.random() < 0.5 else rng.choice(passages)
        rows.append((i * 3, rng.choice([" ", "\n", "\t "]).join(text)))
    rows += [(1000 + k, rows[k % 7][1]) for k in range(15)]  # exact copies
    rows.append((2000, " ".join(["same"] * 70)))  # repeats itself
    rows.append((2001, "a b c d " * 30))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_definition(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == plain(rows)


def test_lengthened_prefixes_give_the_same(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(S, "GROUP", 3)  # nearly every repeated prefix is lengthened to the window
    monkeypatch.setattr(S, "COMMON_SAMPLE", 2)
    assert run(spark, rows) == plain(rows)


def test_edge_rows(spark):
    long = " ".join(f"u{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "few words"), (5, long), (6, "x " + long), (7, " ".join(f"u{i}" for i in range(19)))]
    assert run(spark, rows) == plain(rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_spans(empty, S.repeat_spans(empty)).count() == 0


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"v{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.remove_spans(docs, S.repeat_spans(docs)).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (1, 0), (2, 30)]
    assert {r["doc_id"]: r["kept_text"] for r in got} == {1: text, 2: ""}


def test_extra_columns_and_untouched_texts(spark):
    docs = spark.createDataFrame([(1, "a  b\n", 3, "s"), (2, None, 4, "t")], "doc_id long, text string, n_words int, __x string")
    got = {r["doc_id"]: r for r in S.remove_spans(docs, S.repeat_spans(docs), untouched=True).collect()}
    assert got[1]["kept_text"] == "a  b\n" and got[1]["__x"] == "s" and got[1]["n_words"] == 2
    assert got[2]["kept_text"] is None and got[2]["n_words"] == 0


def test_node_names_are_equal_for_equal_runs():
    rng = np.random.default_rng(0)
    code = rng.integers(0, 3, 500)
    for depth in (1, 2, 5, 20):
        name = S.node_names(code, depth)
        runs = [tuple(code[i:i + depth]) for i in range(len(code) - depth + 1)]
        first = {}
        for i, r in enumerate(runs):
            assert name[first.setdefault(r, i)] == name[i]
        assert len(set(name[: len(runs)].tolist())) == len(set(runs))


def test_repeated_and_missing_ids_lose_only_their_own_words(spark):
    p = " ".join(f"p{i}" for i in range(25))
    other = " ".join(f"u{i}" for i in range(40))
    third = " ".join(f"v{i}" for i in range(30))
    rows = [(1, p, "a"), (2, "a b " + p, "b"), (2, other, "c"), (None, p, "d"), (None, other + " " + third, "e"), (None, third, "f"),
            (4, third, "g"), (4, third, "h"), (5, None, "i"), (5, "", "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row string").repartition(4)
    got = {r["__row"]: r for r in S.remove_repeats(df).collect()}
    assert got["a"]["n_removed"] == 0 and got["c"]["n_removed"] == 0 and got["g"]["n_removed"] == got["h"]["n_removed"] == 0
    assert got["b"]["kept_text"] == "a b" and got["d"]["n_removed"] == 25  # rows without id come last
    assert got["e"]["n_removed"] == 70 and got["f"]["n_removed"] == 30
    assert got["i"]["n_words"] == got["j"]["n_words"] == 0 and len(got) == len(rows)


def test_ids_of_their_own_are_used_as_they_are(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    keyed, key = S.with_row_key(df)
    assert keyed is df and key == "doc_id"


def test_neighbouring_windows_of_a_full_prefix_are_one_span(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 4)
    p = " ".join(f"p{i}" for i in range(70))
    rows = [(i, f"a{i} b{i} {p} c{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    spans = S.repeat_spans(df).collect()
    assert len(spans) < 2 * len(rows) and {r["id"] for r in spans} == set(range(1, 60))
    got = {r["doc_id"]: r["n_removed"] for r in S.remove_spans(df, S.repeat_spans(df)).collect()}
    assert got == {i: 70 if i else 0 for i in range(60)}
