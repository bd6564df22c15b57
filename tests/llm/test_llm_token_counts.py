"""Token counts against the library on whole texts."""

import random

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from labelscope.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def odd_texts():
    rng = random.Random(4)
    parts = ["word", "é", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\u3000", "'s", "I'll", "123", "日本語", "🙂", "<|endoftext|>", "...", "ñandú", "\x85", "à", "\u200b", "\x1c", "x y"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)]


EDGE = [None, "", " ", "  a", "a ", "plain text here", "<|endoftext|>", "a <|endoftext|> b", "x" * 3000, "é è " * 500, " \n \n x"]


def test_counts_equal_the_library(spark):
    texts = EDGE + odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in T.count_tokens(df, PATH, limit=100).collect()}
    assert [got[i]["n_tokens"] for i in range(len(texts))] == library(texts)
    assert [got[i]["n_bytes"] for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got.values())


@pytest.mark.parametrize("chunk,overlap", [(200, 16), (64, 4), (1000, 300)])
def test_chunked_texts_equal_whole_encodings(spark, chunk, overlap):
    rng = random.Random(9)
    words = ["alpha", "béta", "gamma's", "日本", "x1y2", "---", "<|endoftext|>", "\n\n", "  ", "🙂🙂"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(50, 900))) for _ in range(12)]
    texts += ["nospace" * 400, "日本語" * 500, "one " + "y" * 2500 + " two " * 50, ("é" * 40 + " ") * 60, "\u00a0".join(["a b"] * 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in T.count_tokens(df, PATH, chunk_bytes=chunk, overlap_bytes=overlap).collect()}
    assert [got[i] for i in range(len(texts))] == library(texts)


def test_repeated_huge_rows_extra_columns_and_empty_table(spark):
    huge = "some words and more " * 5000
    df = spark.createDataFrame([(1, huge, "a", 3), (1, huge, "b", 4), (None, huge, "c", 5)], "doc_id long, text string, key string, n_tokens int")
    got = T.count_tokens(df, PATH, carry=["doc_id", "key", "n_tokens"]).collect()
    n = library([huge])[0]
    assert sorted((r["key"], r["n_tokens"], r["n_bytes"]) for r in got) == [(k, n, len(huge)) for k in "abc"]
    assert T.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_stable_boundaries_are_token_starts_everywhere():
    t = Tokenizer.from_file(PATH)
    for text in odd_texts()[:150]:
        raw = text.encode()
        lead = {b: i for i, b in enumerate(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80).tolist())}
        starts = {a for a, _ in t.encode(text, add_special_tokens=False).offsets}
        for b in T.stable_boundaries(np.frombuffer(raw, np.uint8)).tolist():
            assert lead[b] in starts
            cut = len(t.encode(raw[:b].decode(), add_special_tokens=False).ids) + len(t.encode(raw[b:].decode(), add_special_tokens=False).ids)
            assert cut == len(t.encode(text, add_special_tokens=False).ids)
