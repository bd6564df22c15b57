"""Cross-tokenizer alignment against whole texts encoded by the libraries."""

import hashlib
import random
from bisect import bisect_left, bisect_right
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from labelscope.llm import cross_align as C

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    """Measures per row, from whole texts and all occurrence pairs."""
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    alphabet = {v: k for k, v in C.byte_alphabet().items()}
    back = {c: b for b, c in alphabet.items()}
    aligned = []
    for _, t in rows:
        full = (" " + t).encode() if t else b""
        a = tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        ta = [bytes(back[c] for c in tok.id_to_token(i)) for i in a]
        tb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(ta) != full or b"".join(tb) != full:
            aligned.append(([], [], [], []))
            continue
        spans = []
        for parts in (ta, tb):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            spans.append(out)
        starts, stops = [u for u, _ in spans[1]], [v for _, v in spans[1]]
        links = [(a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j in range(bisect_right(stops, s), bisect_left(starts, e))]
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, lo = [], 0
        tails = [[v for _, v in s] for s in spans]
        for e in ends:
            groups.append("|".join(",".join(str(i) for i in ids[bisect_right(t, lo): bisect_right(t, e)])
                                   for ids, t in zip((a, b), tails, strict=True)))
            lo = e
        aligned.append((a, b, links, groups))
    count = Counter(x for _, _, links, _ in aligned for x in links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [(i, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
            for (i, _), (a, b, links, groups) in zip(rows, aligned, strict=True)]


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = C.align_tokenizers(df, A, B, carry=["doc_id"], digest=True, **kw)
    return sorted((tuple(r[c] for c in ("doc_id", *C.MEASURES, "groups_sha256")) for r in got.collect()), key=str)


EDGES = [None, "", " ", "  ", "a ", " a", "a  b", "a\n b", "x\ty \n z", "Don't stop, it's <s> fine </s> <|endoftext|> ok", "a▁b c", "<0x41> <unk>",
         "naïve café – straße", "日本語 テスト 中文", "🙂 emoji 👨‍👩‍👧 end", "x\x00y z", "a b c", "é é", "1234567 89", "tail  ", "\n", "ＡＢ c", "w" * 500]


def test_equal_to_whole_texts(spark):
    rng = random.Random(3)
    chars = ["a", "b", "The", " ", "  ", "\n", "é", "ß", "中", "🙂", "▁", ".", "'s", "42", "\t", " ", "tion", "<s>"]
    texts = EDGES + ["".join(rng.choice(chars) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    texts += [rng.choice(texts) for _ in range(100)]
    rows = list(enumerate(texts))
    assert run(spark, rows) == sorted(plain(rows), key=str)


def test_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert run(spark, rows) == sorted(plain(rows), key=str)


def test_rare_pairs_are_joined(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:60]
    expect = sorted(plain(rows), key=str)
    for limit in (0, 5, 200):
        assert run(spark, rows, table_pairs=limit) == expect


def test_whole_texts_give_the_same_units():
    pair = C.Pair(A, B)
    assert pair.in_units and pair.fast is not None
    import pyarrow as pa

    col = pa.array([t for t in EDGES])
    by_unit = C.align_texts(col, pair)
    pair.in_units = False
    whole = C.align_texts(col, pair)
    assert by_unit["groups"] == whole["groups"] and (by_unit["counts"] == whole["counts"]).all()
    assert by_unit["code"].tolist() == whole["code"].tolist() and by_unit["times"].tolist() == whole["times"].tolist()


def test_rows_without_id_repeats_clashing_columns_and_empty_table(spark):
    rows = [(None, "one two", 1, "p"), (None, "one two", 2, "q"), (7, None, 3, "r"), (7, "one two", 4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a long, __text_key string")
    got = C.align_tokenizers(df, A, B)
    assert got.columns == ["doc_id", "text", "__text_key", *C.MEASURES, "groups"]
    out = sorted(((r["doc_id"], r["__text_key"], r["n_a"], r["groups"]) for r in got.collect()), key=str)
    tok = Tokenizer.from_file(A)
    n = len(tok.encode(" one two").ids)
    assert sorted(x[2] for x in out) == [0, n, n, n] and sum(x[3] == "" for x in out) == 1
    assert C.align_tokenizers(df.where("n_a > 9"), A, B).collect() == []


def test_huge_text(spark):
    text = "lorem ipsum dolor " * 40_000
    rows = [(1, text), (2, "lorem")]
    got = {r["doc_id"]: r for r in C.align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()}
    tok = Tokenizer.from_file(A)
    assert got[1]["n_a"] == len(tok.encode(" " + text).ids) and got[1]["n_links"] >= got[1]["n_groups"] > 100_000
