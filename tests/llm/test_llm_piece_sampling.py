"""Sampled segmentations: lossless, reproducible, and from the right distribution."""

from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from labelscope.llm import piece_sampling as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["plain words here", None, "", " ", "  two  spaces\n\n", "a▁b ▁ c", "日本語 text 🙂", "x" * 4000, "tab\tnul\x00 end", "é" * 300 + " z",
         "Ünïcödé words, punctuation!? <0x41> <unk> </s>"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_decoding_is_lossless_and_agrees_with_the_library(spark):
    rows = P.sample_encode(frame(spark, TEXTS), PATH)
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r in P.decode(rows.drop("text"), PATH).collect():
        text = TEXTS[r["doc_id"]] or ""
        assert r["text"] == text
        if "▁" not in text:  # the library decodes a literal mark and its own alike
            assert sp.decode(list(r["piece_ids"])) == text
    digest = P.sample_digest(frame(spark, TEXTS), PATH).collect()
    assert all(d["lossless"] for d in digest)
    assert {d["doc_id"]: d["n_bytes"] for d in digest} == {i: len((t or "").encode()) for i, t in enumerate(TEXTS)}


def test_same_in_any_layout_and_by_seed(spark):
    texts = TEXTS + [f"row {i} of many words and parts" for i in range(200)]
    one = {r["doc_id"]: r["pieces_sha256"] for r in P.sample_digest(frame(spark, texts).coalesce(1), PATH).collect()}
    two = {r["doc_id"]: r["pieces_sha256"] for r in P.sample_digest(frame(spark, texts).repartition(7), PATH).collect()}
    assert one == two
    other = {r["doc_id"]: r["pieces_sha256"] for r in P.sample_digest(frame(spark, texts), PATH, seed=1).collect()}
    assert sum(one[k] != other[k] for k in one) > 150


@pytest.mark.parametrize("word", ["there", "banana", "éa"])
def test_distribution_equals_enumeration(word):
    s = P.load(PATH, 0.7)
    text = " " + word

    def ways(i):
        if i == len(text):
            yield (), 1.0
        for j in range(i + 1, len(text) + 1):
            at = [k for k, b in enumerate(s.bytes) if b == text[i:j].encode() and s.weight[k] > 0]
            for rest, w in ways(j) if at else ():
                yield (at[0], *rest), s.weight[at[0]] * w

    exact = dict(ways(0))
    total = sum(exact.values())
    n = 20_000
    ids, off = s.encode(pa.array([word.encode()] * n, pa.binary()), np.arange(n, dtype=np.uint64) * np.uint64(7919))
    got = Counter(tuple(ids[off[i]: off[i + 1]].tolist()) for i in range(n))
    assert set(got) <= set(exact)
    for k, w in exact.items():
        share = w / total
        assert abs(got[k] / n - share) < 5 * (share * (1 - share) / n) ** 0.5 + 1e-4


def test_invalid_utf8_and_long_units():
    s = P.load(PATH)
    raw = [b"\xff\xfe ab \xe2\x96", b"ok", None, b"y" * 30_000, b"\xf0\x9f\x99\x82" * 50]
    ids, off = s.encode(pa.array(raw, pa.binary()), np.arange(5, dtype=np.uint64))
    back, ends = s.decode(ids, off)
    assert [back[ends[i]: ends[i + 1]].tobytes() for i in range(5)] == [r or b"" for r in raw]


def test_null_keys_repeats_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(None, "some words", 1), (None, "some words", 2), (5, "some words", 3)], "doc_id long, text string, n_pieces int")
    got = P.sample_digest(df, PATH).collect()
    assert len(got) == 3 and got[0]["pieces_sha256"] == got[1]["pieces_sha256"]
    rows = P.sample_encode(df, PATH).collect()
    assert [r["n_pieces"] for r in rows] == [1, 2, 3]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.sample_digest(empty, PATH).count() == 0 and P.sample_encode(empty, PATH).count() == 0
