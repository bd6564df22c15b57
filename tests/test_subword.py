"""Subword encoding (T1) against a plain merge loop and the library."""

import random
from collections import Counter

import pytest

from labelscope.operators import subword as S

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def plain_merge(merges, word):
    part = [merges.letters[b] for b in word.encode()]
    while True:
        ranked = [(merges.rank[p], p) for p in zip(part, part[1:]) if p in merges.rank]
        if not ranked:
            return [merges.ids[p] for p in part]
        left, right = min(ranked)[1]
        out, i = [], 0
        while i < len(part):
            both = i + 1 < len(part) and (part[i], part[i + 1]) == (left, right)
            out.append(left + right if both else part[i])
            i += 1 + both
        part = out


WORDS = [" the", "hello", " Spark", "aaaaaaaa", "aaaaaaaaa", " tokenization", "ß", " ünïcödé", "日本語", "🙂🙂", "....", "  ", "\n\n", "'s", " 1234567",
         "abababab", "=-=-=-=-", " antidisestablishmentarianism"]


def test_merges_equal_a_plain_loop_and_the_library(library):
    merges = S.Merges(PATH)
    rng = random.Random(1)
    words = WORDS + ["".join(rng.choice("abcest ihnr"[:10]) for _ in range(rng.randrange(1, 25))) for _ in range(500)]
    for w in words:
        assert merges.tokens(w) == plain_merge(merges, w)
    for w in WORDS:
        assert merges.tokens(w) == library.encode(w, add_special_tokens=False).ids
    assert merges.tokens("") == []


TEXTS = ["def f(x):\n    return x  # it's fine\n", None, "", " ", "   ", "a  b   c\n\n\n d", "x\ty", "été 12 ½ ³ 日本語 text", "no break space 　 wide",
         "<|endoftext|> plain", "don't we'll I'm you've they'd 'S", "w " * 700, "x" * 3000, "trailing  \n "]


def run(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "Go") for i, t in enumerate(texts)], "id long, code string, language string").repartition(3)
    return {r["id"]: r for r in S.subword_encode(df, PATH, "id", **kw).collect()}


def test_encoding_equals_the_library(spark, library):
    got = run(spark, TEXTS, max_length=512, pad=9)
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids[:512]
        assert got[i]["input_ids"] == ids + [9] * (512 - len(ids)), t
        assert got[i]["attention_mask"] == [1] * len(ids) + [0] * (512 - len(ids))


def test_marks_and_short_lengths(spark, library):
    for length in (2, 3, 10):
        got = run(spark, TEXTS, max_length=length, bos=1, eos=2, pad=0)
        for i, t in enumerate(TEXTS):
            ids = [1, *library.encode(t or "", add_special_tokens=False).ids[: length - 2], 2]
            assert got[i]["input_ids"] == ids + [0] * (length - len(ids))
    with pytest.raises(ValueError):
        run(spark, ["a"], max_length=1, bos=1, eos=2)


def test_language_prefix(spark, library):
    got = run(spark, ["x = 1"], max_length=16, language_col="language")
    ids = library.encode("# Language: Go\nx = 1").ids
    assert got[0]["input_ids"] == ids + [0] * (16 - len(ids))


def test_types_of_a_corpus(spark, library):
    df = spark.createDataFrame([(t,) for t in TEXTS * 2], "code string").repartition(3)
    rows = S.subword_types(df, PATH).collect()
    assert len({r["type"] for r in rows}) == len(rows)
    total = Counter()
    for r in rows:
        assert r["token_ids"] == library.encode(r["type"], add_special_tokens=False).ids
        for x in r["token_ids"]:
            total[x] += r["count"]
    assert total == Counter(x for t in TEXTS * 2 for x in library.encode(t or "", add_special_tokens=False).ids)
    assert sum(r["count"] * len(r["type"]) for r in rows) == 2 * sum(len(t or "") for t in TEXTS)


def test_empty_table_and_other_vocabularies(spark):
    df = spark.createDataFrame([], "id long, code string")
    assert S.subword_encode(df, PATH, "id").collect() == [] and S.subword_types(df, PATH).collect() == []
    with pytest.raises(ValueError):
        S.Merges(public_tokenizers.path("word_bpe_49k.json"))
