"""Kneser-Ney model against a plain computation; classifier edge cases."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelscope.llm import kneser_ney as K
from labelscope.llm._text import Words

SF = "/root/testdata/sf0.01"
#: Least share of rows with repeated words that the model rejects.
REPEATS = 0.06


def plain_model(words, order):
    """Interpolated modified Kneser-Ney over dictionaries; returns p(symbol | context)."""
    raw = defaultdict(Counter)
    for w in words:
        s = ("^", *w, "$")
        for j in range(1, len(s)):
            for n in range(1, min(order, j + 1) + 1):
                raw[n][s[j - n + 1: j + 1]] += 1
    left = Counter()
    for n in range(2, order + 1):
        for g in raw[n]:
            left[g[1:]] += 1
    count = {n: {g: (c if n == order or g[0] == "^" else left[g]) for g, c in raw[n].items()} for n in raw}
    disc = {}
    for n in count:
        k = Counter(count[n].values())
        if not k[1]:
            disc[n] = (0.5, 1.0, 1.5)
            continue
        y = k[1] / (k[1] + 2 * k[2])
        d = []
        for i, usual in ((1, 0.5), (2, 1.0), (3, 1.5)):
            x = i - (i + 1) * y * k[i + 1] / k[i] if k[i] else usual
            d.append(min(max(x, 0.05), i))
        disc[n] = tuple(d)
    total, held, kinds = Counter(), Counter(), Counter()
    for n in count:
        for g, c in count[n].items():
            total[g[:-1]] += c
            held[g[:-1]] += disc[n][min(c, 3) - 1]
            kinds[g[:-1]] += 1

    def p(context, symbol):
        value = 1.0 / (kinds[()] + 1)
        for n in range(len(context) + 1):
            h = context[len(context) - n:]
            if h not in total:
                continue
            c = count.get(n + 1, {}).get((*h, symbol), 0)
            a = max(c - disc[n + 1][min(c, 3) - 1], 0) / total[h] if c else 0.0
            value = a + held[h] / total[h] * value
        return value

    return p


def plain_cost(p, word, order):
    s = ("^", *word, "$")
    return -sum(math.log(p(s[max(0, j - order + 1): j], s[j])) for j in range(1, len(s)))


TRAIN = ["banana bandana", "band ana nab", "bandit ban ban", "añb añb xyz", "q", "cab cabana"]


@pytest.mark.parametrize("order", [2, 3, 5])
def test_perplexity_equals_plain(spark, order):
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(TRAIN)], "id long, lang string, text string")
    blocks = K.shard_blocks(docs, "id", "lang", "text", ["id"], 3)
    ids = docs.select(K.shard_of("id", 3).alias("shard"), "id").repartition(3, "shard")
    model = K.model_table(K.count_ngrams(blocks, ids, order), order)
    tests = [*TRAIN, "banana", "zzz unseen ✓", "b"]
    more = spark.createDataFrame([(i, "en", t) for i, t in enumerate(tests)], "id long, lang string, text string")
    got = K.perplexities(K.shard_blocks(more, "id", "lang", "text", ["id"], 2), model, order, [more.schema["id"]]).collect()
    p = plain_model([w for t in TRAIN for w in t.split()], order)
    for r in got:
        words = tests[r["id"]].split()
        n = sum(len(w) + 1 for w in words)
        assert r["n_symbols"] == n
        assert r["perplexity"] == pytest.approx(math.exp(sum(plain_cost(p, w, order) for w in words) / n), rel=1e-5)


@pytest.mark.parametrize("order", [2, 3, 5])
def test_running_text_equals_plain(spark, order):
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(TRAIN)], "id long, lang string, text string")
    blocks = K.shard_blocks(docs, "id", "lang", "text", ["id"], 3)
    ids = docs.select(K.shard_of("id", 3).alias("shard"), "id").repartition(3, "shard")
    model = K.model_table(K.count_ngrams(blocks, ids, order, across=True), order)
    tests = [*TRAIN, "  nab ana\n\tband ", "ban ban ban ban", "zzz unseen ✓", "b", " \n"]
    more = spark.createDataFrame([(i, "en", t) for i, t in enumerate(tests)], "id long, lang string, text string")
    got = K.perplexities(K.shard_blocks(more, "id", "lang", "text", ["id"], 2), model, order, [more.schema["id"]], across=True).collect()
    p = plain_model(["$".join(t.split()) for t in TRAIN], order)
    assert len(got) == len(tests)
    for r in got:
        words = tests[r["id"]].split()
        n = sum(len(w) + 1 for w in words)
        assert r["n_symbols"] == n
        if n:
            assert r["perplexity"] == pytest.approx(math.exp(plain_cost(p, "$".join(words), order) / n), rel=1e-5)
        else:
            assert r["perplexity"] is None


def test_large_alphabets_keep_grams_apart():
    symbols = np.concatenate([[2], np.arange(10, 9000), np.arange(10, 9000), [2], np.arange(10, 9000)]).astype(np.uint64)
    j = np.concatenate([np.arange(1 + 2 * 8990), np.arange(8991)])
    for order in (2, 5):
        code, at = K.distinct_grams(symbols, j, order)
        place = np.flatnonzero(j)
        gram = [tuple(symbols[max(i - order + 1, i - j[i]): i + 1].tolist()) for i in place]
        assert len(at) == len(set(gram)) == len(set(zip(code.tolist(), gram, strict=True)))
        assert all(gram[k] == gram[int(np.searchsorted(place, at[c]))] for k, c in enumerate(code.tolist()))


def test_order_of_words_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    mixed = docs.selectExpr("doc_id + 1000000 AS doc_id", "array_join(array_sort(split(text, '\\\\s+')), ' ') AS text", "lang")
    got = {r["doc_id"]: r["perplexity"] for r in K.classify(docs.unionByName(mixed), labels, carry=["doc_id"]).collect()}
    # rows without a label are in no model's counts
    rest = [r["doc_id"] for r in docs.join(labels, "doc_id", "left_anti").collect()]
    assert np.mean([got[i + 1000000] > 1.02 * got[i] for i in rest]) > 0.9


def test_every_kind_of_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = K.classify(docs, labels, carry=["doc_id", "text"]).join(labels, "doc_id").where("quality = 0").collect()
    kinds = defaultdict(list)
    for r in got:
        t = r["text"]
        kinds["caps" if "!!" in t else "symbols" if "$$$" in t or "###" in t else "menu" if " | " in t else "repeat"].append(not r["kept"])
    rejected = {k: sum(v) / len(v) for k, v in kinds.items()}
    assert rejected["caps"] == 1 and rejected["symbols"] == 1 and rejected["menu"] > 0.95
    # a repeated word inside clean text is partly out of an n-gram's reach
    assert rejected["repeat"] > REPEATS


def test_own_fold_is_left_out(spark):
    texts = [*TRAIN, "a band ban", "xyz ñb", "cab bandit", "ana"]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id < 8 AS int) AS quality")
    got = {r["doc_id"]: r for r in K.classify(docs, labels, order=3, folds=3).collect()}
    fold = {r["doc_id"]: r["s"] % 3 for r in docs.select("doc_id", K.shard_of("doc_id", 9, 3).alias("s")).collect()}
    assert len({fold[i] for i in range(8)}) == 3
    for i, t in enumerate(texts):
        p = plain_model(["$".join(u.split()) for k, u in enumerate(texts) if k < 8 and fold[k] != fold[i]], 3)
        assert got[i]["perplexity"] == pytest.approx(math.exp(plain_cost(p, "$".join(t.split()), 3) / (len(t) + 1)), rel=1e-5)
    assert {r["threshold"] for r in got.values()} == {max(got[i]["perplexity"] for i in range(8)) * K.SLACK}


def test_thresholds_by_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = K.classify(docs, labels, carry=["doc_id", "lang", "text"]).join(labels, "doc_id").collect()
    for lang in ("en", "de", "fr", "es"):
        rows = [r for r in got if r["lang"] == lang]
        clean = sorted(r["perplexity"] for r in rows if r["quality"] == 1)
        assert {r["threshold"] for r in rows} == {clean[math.ceil(K.QUANTILE * len(clean)) - 1] * K.SLACK}
        assert np.mean([r["kept"] for r in rows if r["quality"] == 1]) > 0.99
        menus = [r["kept"] for r in rows if r["quality"] == 0 and " | " in r["text"]]
        assert np.mean(menus) < 0.05


def test_plain_probabilities_sum_to_one():
    words = [w for t in TRAIN for w in t.split()]
    p = plain_model(words, 3)
    alphabet = sorted({c for w in words for c in w} | {"$"})
    for context in [(), ("^",), ("a", "n"), ("n",), ("^", "b")]:
        # what is left goes to unseen symbols, one share of the last back-off
        assert 0.9 < sum(p(context, s) for s in alphabet) <= 1.0 + 1e-9


def test_keys_lookup_and_distinct():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    look = K.Lookup(keys)
    assert (look.find(keys) == np.arange(5000)).all()
    assert (look.find(rng.integers(2**63, 2**64, 1000, dtype=np.uint64)) == -1).all()
    many = np.concatenate([keys, keys[:2000], np.zeros(3, np.uint64)])
    assert sorted(K.distinct(many, bits=6).tolist()) == sorted(set(many.tolist()))


def test_word_symbols():
    s, first = K.word_symbols(pa.array([b"ab", "é".encode(), b"x"], pa.binary()))
    assert s.tolist() == [2, 101, 102, 3, 2, 0xE9 + 4, 3, 2, 124, 3] and first.tolist() == [0, 4, 7, 10]


def test_junk_goes_and_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = K.classify(docs, labels, carry=["doc_id", "text"]).join(labels, "doc_id").collect()
    clean = [r["kept"] for r in got if r["quality"] == 1]
    caps = [r["kept"] for r in got if r["quality"] == 0 and ("!!" in r["text"] or "$$$" in r["text"])]
    assert sum(clean) / len(clean) > 0.99 and sum(caps) / len(caps) < 0.02


def test_edge_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "some words here", None), (4, "no model", "xx"), (5, "some words", "en"),
            (5, "some words", "en"), (None, "some words", "en"), (6, "word " * 60_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS kept", "1 AS __y", "7 AS id", "'s' AS shard")
    labels = spark.createDataFrame([(5, 1), (6, 1), (4, 0), (None, 1), (99, 1)], "doc_id long, quality int")
    got = K.classify(docs, labels).collect()
    assert len(got) == len(rows) and got[0]["__y"] == 1 and got[0]["id"] == 7 and got[0]["shard"] == "s"
    by = {(r["doc_id"], r["text"]): r for r in got}
    assert all(r["kept"] for r in got if r["perplexity"] is None)
    assert by[1, None]["perplexity"] is None and by[3, "some words here"]["perplexity"] is None
    assert by[5, "some words"]["perplexity"] > 1 and by[5, "some words"]["n_symbols"] == 11
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r["kept"] for r in K.classify(docs, none).collect())
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert K.classify(empty, labels).count() == 0


def test_shards_do_not_change_the_scores(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    one = {r["doc_id"]: r["perplexity"] for r in K.classify(docs, labels, carry=["doc_id"]).collect()}
    monkeypatch.setattr(K, "MIN_SHARDS", 3)
    monkeypatch.setattr(K, "SHARD_BYTES", 200_000)
    two = {r["doc_id"]: r["perplexity"] for r in K.classify(docs.repartition(5), labels, carry=["doc_id"]).collect()}
    assert one.keys() == two.keys()
    assert all(one[k] == pytest.approx(two[k], rel=1e-6) for k in one if one[k] is not None)


def test_only_likely_trusted_rows_are_counted(spark):
    """Of the rows that are shuffled to be counted, no trusted one is missing and few others are left."""
    rows = [(None if i % 50 == 7 else i // 2, f"text {i}") for i in range(8000)]
    for kind in ("long", "string"):
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
        trusted = spark.range(0, 4000, 10).select(F.col("id").cast(kind).alias("id"))
        kept = [(int(r.doc_id), r.text) for r in K.maybe_trusted(docs, "doc_id", trusted).collect()]
        want = [(i, t) for i, t in rows if i is not None and i % 10 == 0]
        assert len(set(kept)) == len(kept) and set(want) <= set(kept) <= set(rows)
        assert len(kept) - len(want) < len(rows) // 8
        assert K.maybe_trusted(docs, "doc_id", trusted.limit(0)).count() == 0


def test_running_symbols_equal_plain():
    texts = ["ab c", None, "", " \t", "é漢 x😀\n", "a" * 5, "x\ty  z "]
    symbols, since, off = K.text_symbols(Words(pa.array([None if t is None else t.encode() for t in texts], pa.binary())), True)
    plain = [[2, *(s for w in (t or "").split() for s in [*(ord(c) + 4 for c in w), 3])] if (t or "").split() else [] for t in texts]
    assert [symbols[a:b].tolist() for a, b in zip(off, off[1:], strict=False)] == plain
    assert since.tolist() == [i for p in plain for i in range(len(p))]
    code, at = K.distinct_grams(symbols, since, 3)
    ends = [tuple(p[max(i - 2, 0): i + 1]) for p in plain for i in range(1, len(p))]
    assert len(at) == len(set(ends)) and len({*zip(code.tolist(), ends, strict=True)}) == len(at)


def test_turns_share_out_the_shards(spark):
    docs = spark.createDataFrame([(None if i % 9 == 0 else i, "en", f"text {i}") for i in range(300)], "doc_id long, lang string, text string")
    seen, texts = [], []
    for k in range(K.TURNS):
        rows = K.shard_blocks(docs, "doc_id", "lang", "text", [], 20, 5, (k, K.TURNS)).collect()
        seen.append({r.shard for r in rows})
        texts += [t.decode() for r in rows for part in K.unpack(pa.scalar(r.block, pa.binary())) for t in part.column("__text").to_pylist()]
    assert [len(s) for s in seen] == [10, 10] and not seen[0] & seen[1]
    assert sorted(texts) == sorted(f"text {i}" for i in range(300))
