"""Alignment of two tokenizers over a corpus, on distinct texts.

Documents are grouped by their full text, so each distinct text is encoded by
both vocabularies and aligned once; counts of linked id pairs are weighted by
the number of documents that hold the text, and the measures are joined back to
the documents.

* Vocabulary A is a byte-level BPE (``tokenizers`` JSON), vocabulary B a BPE of
  SentencePiece; A reads a space and the text, B the text (it adds the space).
* A text is *aligned* when the joined bytes of either side's tokens are a space
  and the text. Byte offsets where tokens of both sides end cut the tokens into
  groups; an A token and a B token are linked when their byte ranges overlap.
* ``pair_counts`` sums the links of every id pair over all documents.

Both vocabularies always cut before a space that follows a visible ASCII
character (checked when the files are loaded; otherwise a text is one unit), so
inside a task the distinct units between such cuts are encoded and aligned once
and put together per text. Whole texts are read, however long.

Pair counts are looked up in a broadcast table of at most ``table_pairs`` pairs,
the most frequent ones; where a corpus has more, links of the remaining pairs
(rare ones, so no key is hot) are joined by pair.

Defined results: null and empty texts, and texts whose joined bytes differ, have
no tokens: zero counts and empty groups. Repeated rows and rows without id each
get the measures of their text. Extra columns pass through ``carry``, also those
named like an internal column; those named like a result column are left out.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm._io import stage_table, tidy_shuffles
from labelscope.llm._text import per_doc, text_bytes, text_slices

#: Pairs whose counts are broadcast, at most (16 bytes each).
TABLE_PAIRS = 1_000_000
#: Text of units that are encoded in one call.
JOINED_BYTES = 64 << 10
#: Text of a slice of whole documents whose distinct units are encoded together.
SLICE_BYTES = 4 << 20

# Fixed value: how a byte-level vocabulary cuts text before it merges.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Two loaded vocabularies."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        vocab = self.a.get_vocab(with_added_tokens=True)
        in_a = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            in_a[i] = bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        in_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sides = Vocabulary(in_a, ",|"), Vocabulary(in_b, ",;")
        self.texts = pa.array(self.sides[0].texts + self.sides[1].texts, pa.large_string())
        self.size_b, self.codes = len(in_b), len(in_a) * len(in_b)
        self.space_b = self.b.piece_to_id("▁")
        self.fast = self._ranked(path_a, vocab, in_a) if self._cuts_a(path_a) else None
        self.in_units = self._cuts_a(path_a) and self._cuts_b(pieces)

    @staticmethod
    def _cuts_a(path: str) -> bool:
        """A plain byte-level file: its pre-tokens hold no space after a visible character."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        return (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                and not pre.get("add_prefix_space") and all(t.get("special") for t in spec.get("added_tokens", [])))

    def _cuts_b(self, pieces: list[str]) -> bool:
        """No normalisation, a space before the text, and no piece with a space after another character."""
        plain = all(self.b.decode(self.b.encode(t)) == t for t in (" a  b\t c ", "ａé"))
        prefix = self.b.encode("a", out_type=str)[0].startswith("▁")
        return plain and prefix and self.space_b != self.b.unk_id() and not any("▁" in p.lstrip("▁") for p in pieces)

    def _ranked(self, path: str, vocab: dict[str, int], tokens: list[bytes]):
        """An encoder by ranks with the same merges (several times as fast), where
        the file's ids follow the order of its merges; None otherwise."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in merges]
        added = set(self.a.get_added_tokens_decoder())
        ranks = {t: i for i, t in enumerate(tokens) if t and i not in added}
        plain = all(bytes([b]) in ranks for b in range(256)) and len(ranks) == 256 + len(made) and min(made) >= 256
        if not plain or made != sorted(made):
            return None
        return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def tokens_a(self, texts: list[bytes]) -> list[list[int]]:
        if self.fast is not None and all(t.isascii() for t in texts):  # on ASCII both read the pattern alike
            return [self.fast.encode_ordinary(t.decode()) for t in texts]
        return [e.ids for e in self.a.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def tokens_b(self, texts: list[bytes]) -> list[list[int]]:
        """The texts start with the space that B adds; one space alone ends a text."""
        return [b or [self.space_b] for b in self.b.encode([t[1:].decode("utf-8", "replace") for t in texts], num_threads=1)]

    def encode(self, data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """``(token ids, tokens per unit)`` of the units ``data[off[i]:off[i + 1]]``
        by A and by B. Units that end in a visible ASCII character are joined to
        stretches of ``JOINED_BYTES`` before they are encoded, which changes no
        token as both sides cut between them; where the tokens' lengths do not add
        up to the units' all the same, and for other units, each is encoded alone."""
        last = data[off[1:] - 1]
        alone = (last <= 0x20) | (last >= 0x7F) | (not self.in_units)
        at = np.flatnonzero(data[:-2] == 0xE2)
        at = at[(data[at + 1] == 0x96) & (data[at + 2] == 0x81)]  # U+2581 reads as a space
        alone[np.searchsorted(off, at, side="right") - 1] = True
        size = np.diff(off)
        found = [([], []), ([], [])]  # places and tokens, by side
        ascii_ = per_doc(data >= 0x80, off) == 0
        joined = np.concatenate([np.flatnonzero(~alone & ascii_), np.flatnonzero(~alone & ~ascii_)])
        total = np.cumsum(size[joined])
        for part in np.split(joined, np.searchsorted(total, np.arange(JOINED_BYTES, total[-1] if len(total) else 0, JOINED_BYTES))):
            if not len(part):
                continue
            text = data[_spread(size[part], off[part])].tobytes()
            ends = np.cumsum(size[part])
            cut = []
            for vocabulary, encode in zip(self.sides, (self.tokens_a, self.tokens_b), strict=True):
                flat = np.array(encode([text])[0], np.int64)
                to = np.cumsum(vocabulary.lens[flat])
                n = np.searchsorted(to, ends, side="right")
                cut.append((flat, n, to[-1] == ends[-1] and (to[n - 1] == ends).all()))
            if not all(c[2] for c in cut):
                alone[part] = True
                continue
            for side, (flat, n, _) in zip(found, cut, strict=True):
                side[0].append((part, np.diff(n, prepend=0)))
                side[1].append(flat)
        rest = np.flatnonzero(alone)
        texts = [data[off[i]: off[i + 1]].tobytes() for i in rest.tolist()]
        out = []
        for side, encode in zip(found, (self.tokens_a, self.tokens_b), strict=True):
            lists = encode(texts) if texts else []
            side[0].append((rest, np.fromiter(map(len, lists), np.int64, len(lists))))
            side[1].append(np.fromiter(chain.from_iterable(lists), np.int64))
            n = np.zeros(len(size), np.int64)
            place, each = (np.concatenate(x) for x in zip(*side[0], strict=True))
            n[place] = each
            starts = np.zeros(len(size), np.int64)
            starts[place] = np.cumsum(each) - each
            out.append((np.concatenate(side[1])[_spread(n, starts)], n))
        return out


class Vocabulary:
    """Bytes of every token, end to end, and the text of every id with what can follow it."""

    def __init__(self, tokens: list[bytes], marks: str):
        self.size = len(tokens)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.lens = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.texts = [f"{i}{mark}" for mark in marks for i in range(self.size)]


class Units:
    """Distinct units of a slice, aligned together: per unit whether it is aligned,
    its tokens, groups and links; all link codes; and its groups as text, each
    closed by a semicolon."""

    def __init__(self, pair: Pair, raw: pa.Array):
        data, off = text_bytes(raw)
        size = np.diff(off)
        ids, counts = zip(*pair.encode(data, off), strict=True)
        ok = np.ones(len(size), bool)
        for vocabulary, flat, n in zip(pair.sides, ids, counts, strict=True):
            ok &= per_doc(vocabulary.lens[flat], np.append(0, np.cumsum(n))) == size
        for vocabulary, flat, n in zip(pair.sides, ids, counts, strict=True):  # bytes, where the lengths are right
            flat = flat[np.repeat(ok, n)]
            same = vocabulary.bytes[_spread(vocabulary.lens[flat], vocabulary.starts[flat])] == data[_spread(size[ok], off[:-1][ok])]
            ok[ok] = per_doc(~same, np.append(0, np.cumsum(size[ok]))) == 0
        self.ok = ok
        a, b = (flat[np.repeat(ok, n)] for flat, n in zip(ids, counts, strict=True))
        end_a, end_b = (np.cumsum(v.lens[x]) for v, x in zip(pair.sides, (a, b), strict=True))
        unit_end = np.cumsum(np.where(ok, size, 0))
        # between neighbouring ends lies one token of each side: a link
        ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        again = ends[1:] == ends[:-1]
        shared, ends = ends[1:][again], ends[np.append(True, ~again)[: len(ends)]]
        self.codes = a[np.searchsorted(end_a, ends)] * pair.sides[1].size + b[np.searchsorted(end_b, ends)]
        split = [np.append(0, np.searchsorted(x, unit_end, side="right")) for x in (end_a, end_b, shared, ends)]
        self.counts = np.array([np.diff(x) for x in split])
        self.first_link = split[3][:-1]
        # tokens in the order of the text: a group's tokens of A, then those of B
        last_a, last_b = np.isin(end_a, shared, assume_unique=True), np.isin(end_b, shared, assume_unique=True)
        group = np.concatenate([2 * np.searchsorted(shared, end_a), 2 * np.searchsorted(shared, end_b) + 1])
        entry = np.concatenate([a + last_a * pair.sides[0].size, 2 * pair.sides[0].size + b + last_b * pair.sides[1].size])
        text = pair.texts.take(pa.array(entry[np.argsort(group, kind="stable")]))
        _, at = text_bytes(text)
        self.text = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at[split[0] + split[1]]), text.buffers()[2]])


_LOADED: dict = {}


def _pair(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Pair(path_a, path_b)
    return _LOADED[path_a, path_b]


def _spread(lens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] + 0 .. lens[i] - 1`` for every i, one after another."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lens - starts, lens)


def align_texts(col: pa.Array, pair: Pair) -> dict:
    """Counts, groups and distinct links (code and times, in lists) of each text."""
    texts, n = col.fill_null(""), len(col)
    full = np.asarray(pc.binary_length(texts)) > 0
    row = np.flatnonzero(full)
    counts, groups = np.zeros((4, n), np.int64), [b""] * n
    if not len(row):
        empty = np.zeros(0, np.int64)
        return {"counts": counts, "groups": groups, "first": np.zeros(n + 1, np.int64), "code": empty, "times": empty}
    spaced = pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts.filter(pa.array(full)), pa.scalar("", texts.type))
    data, off = text_bytes(spaced.combine_chunks() if isinstance(spaced, pa.ChunkedArray) else spaced)
    edge = np.zeros(len(data) + 1, bool)
    if pair.in_units:
        edge[1:-1] = (data[1:] == 32) & (data[:-1] > 0x20) & (data[:-1] < 0x7F)
    edge[off] = True
    cuts = np.flatnonzero(edge)
    coded = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1,
                                  [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
    units, unit = Units(pair, coded.dictionary), np.asarray(coded.indices)
    first = np.searchsorted(cuts, off)  # units of each document
    good = np.logical_and.reduceat(units.ok[unit], first[:-1])
    counts[:, row] = np.add.reduceat(units.counts[:, unit], first[:-1], axis=1) * good
    chosen = units.text.take(pa.array(unit))
    raw, at = text_bytes(chosen)
    raw, at = memoryview(raw), at[first]
    for i, r in enumerate(row.tolist()):
        if good[i]:
            groups[r] = bytes(raw[at[i]: at[i + 1] - 1])  # without the last semicolon
    lens = units.counts[3, unit] * np.repeat(good, np.diff(first))
    code = units.codes[_spread(lens, units.first_link[unit])]
    owner = np.repeat(np.repeat(np.arange(len(row)), np.diff(first)), lens)
    key, times = np.unique(owner * np.int64(pair.codes) + code, return_counts=True)
    owner, code = row[key // pair.codes], key % pair.codes
    return {"counts": counts, "groups": groups, "first": np.searchsorted(owner, np.arange(n + 1)), "code": code, "times": times}


def aligned_texts(docs: DataFrame, vocab_a: str, vocab_b: str, text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per distinct text that is not null: ``key`` (its SHA-256),
    ``n_docs``, the counts, ``groups`` (``a1,a2|b1;a3|b2``; with ``digest`` their
    SHA-256, '' without tokens) and the distinct links ``code`` with ``times``;
    a code is ``a_id * size of B + b_id``. Staged."""
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null").groupBy("text").agg(F.count("*").alias("n_docs"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(vocab_a, vocab_b)
        for batch in batches:
            for part in text_slices(batch, limit=SLICE_BYTES):
                got = align_texts(part.column(0), pair)
                groups = got["groups"]
                if digest:
                    groups = [hashlib.sha256(g).hexdigest().encode() if g else b"" for g in groups]
                first = pa.array(got["first"], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.sha256(t).hexdigest() for t in part.column(0).cast(pa.binary()).to_pylist()], pa.string()), part.column(1),
                     *(pa.array(c) for c in got["counts"]), pa.array(groups, pa.large_binary()).cast(pa.large_string()),
                     pa.ListArray.from_arrays(first, pa.array(got["code"])), pa.ListArray.from_arrays(first, pa.array(got["times"], pa.int32()))],
                    ["key", "n_docs", *MEASURES[:4], "groups", "code", "times"])

    schema = "key string, n_docs long, n_a long, n_b long, n_groups long, n_links long, groups string, code array<long>, times array<int>"
    return stage_table(texts.mapInArrow(align, schema), "aligned-texts")


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column(batch.schema.get_field_index(name))
    off = np.asarray(col.offsets, np.int64)
    return np.asarray(col.values)[off[0]: off[-1]], off - off[0]


def pair_counts(texts: DataFrame, vocab_a: str, vocab_b: str) -> DataFrame:
    """``(code, a_id, b_id, n_links, best)`` of every linked id pair over all
    documents; ``best``: no other pair of its B id has more links. Staged."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            code, off = _lists(batch, "code")
            times, _ = _lists(batch, "times")
            weight = np.repeat(np.asarray(batch.column(batch.schema.get_field_index("n_docs"))), np.diff(off))
            codes, at = np.unique(np.concatenate([codes, code]), return_inverse=True)
            sums = _sum_at(at, np.concatenate([sums, times * weight]), len(codes))
            if len(codes) > 4 * TABLE_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums)], ["code", "n"])
                codes, sums = codes[:0], sums[:0]
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums)], ["code", "n"])

    size = _pair(vocab_a, vocab_b).size_b
    sums = texts.select("n_docs", "code", "times").mapInArrow(partial, "code long, n long").groupBy("code").agg(F.sum("n").alias("n_links"))
    sums = stage_table(sums.select("code", F.expr(f"code div {size}").alias("a_id"), (F.col("code") % size).alias("b_id"), "n_links"), "pair-counts")
    top = sums.groupBy("b_id").agg(F.max("n_links").alias("top"))  # a row per id of B
    return sums.join(F.broadcast(top), "b_id").select("code", "a_id", "b_id", "n_links", (F.col("n_links") == F.col("top")).alias("best"))


def _sum_at(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact integer sums of ``values`` by index."""
    order = np.argsort(at, kind="stable")
    if not len(order):
        return np.zeros(n, np.int64)
    return np.add.reduceat(values[order], np.searchsorted(at[order], np.arange(n)))


def frequent_pairs(pairs: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """Pairs with at least the smallest power of two as count that leaves no
    more than ``limit`` pairs, and whether these are all."""
    level = F.length(F.conv(F.col("n_links").cast("string"), 10, 2))
    sizes = {r["level"]: r["n"] for r in pairs.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    total, floor = 0, 65
    for at in sorted(sizes, reverse=True):
        if total + sizes[at] > limit:
            break
        total, floor = total + sizes[at], at
    return pairs.where(level >= floor), total == sum(sizes.values())


def measure_texts(texts: DataFrame, pairs: DataFrame, table_pairs: int = TABLE_PAIRS) -> DataFrame:
    """``texts`` (aligned) with ``n_best`` and ``count_sum`` in place of the links."""
    frequent, whole = frequent_pairs(pairs, table_pairs)
    rows = frequent.select("code", "n_links", "best").toArrow().sort_by("code")
    table = texts.sparkSession.sparkContext.broadcast(tuple(rows[c].to_numpy() for c in ("code", "n_links", "best")))
    kept = ["key", *MEASURES[:4], "groups"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sums, best = table.value
        for batch in batches:
            code, off = _lists(batch, "code")
            times = _lists(batch, "times")[0].astype(np.int64)
            at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            known = codes[at] == code if len(codes) else np.zeros(len(code), bool)
            total = np.zeros(len(code) + 1, np.int64)
            winners = np.zeros(len(code) + 1, np.int64)
            if len(codes):
                np.cumsum(times * sums[at] * known, out=total[1:])
                np.cumsum(times * best[at] * known, out=winners[1:])
            open_off = np.zeros(len(code) + 1, np.int64)
            np.cumsum(~known, out=open_off[1:])
            rest = pa.array(open_off[off], pa.int32())
            cols = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(winners[off[1:]] - winners[off[:-1]]), pa.array(total[off[1:]] - total[off[:-1]]),
                 pa.ListArray.from_arrays(rest, pa.array(code[~known])), pa.ListArray.from_arrays(rest, pa.array(times[~known]))],
                [*kept, "n_best", "count_sum", "code", "times"])

    schema = ("key string, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, "
              "count_sum long, code array<long>, times array<long>")
    found = texts.select(*kept, "code", "times").mapInArrow(look_up, schema)
    if whole:
        return found.drop("code", "times")
    found = stage_table(found, "text-measures")
    links = found.select("key", F.explode(F.arrays_zip("code", "times")).alias("x")).select("key", "x.code", "x.times")
    rare = (links.join(pairs.select("code", F.col("n_links").alias("__n"), "best"), "code").groupBy("key")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("__best"),
                 F.sum(F.col("times") * F.col("__n")).alias("__sum")))
    return (found.drop("code", "times").join(rare, "key", "left")
            .withColumn("n_best", F.col("n_best") + F.coalesce("__best", F.lit(0)))
            .withColumn("count_sum", F.col("count_sum") + F.coalesce("__sum", F.lit(0))).drop("__best", "__sum"))


def align_tokenizers(docs: DataFrame, vocab_a: str, vocab_b: str, text_col: str = "text", carry: list[str] | None = None,
                     digest: bool = False, table_pairs: int = TABLE_PAIRS) -> DataFrame:
    """``carry`` columns of every document with the measures of its text and its
    token ``groups`` (with ``digest``: ``groups_sha256`` instead)."""
    tidy_shuffles(docs.sparkSession)
    name = "groups_sha256" if digest else "groups"
    carry = [c for c in (docs.columns if carry is None else carry) if c not in (*MEASURES, name)]
    texts = aligned_texts(docs, vocab_a, vocab_b, text_col, digest)
    found = measure_texts(texts, pair_counts(texts, vocab_a, vocab_b), table_pairs)
    found = found.select(F.col("key").alias("__text_key"), F.struct(*MEASURES, "groups").alias("__measures"))
    src = docs.select(F.struct(*(F.col(c) for c in carry)).alias("__row"), F.sha2(F.col(text_col), 256).alias("__text_key"))
    joined = src.join(found, "__text_key", "left")
    zero = [F.coalesce(F.col("__measures")[c], F.lit(0)).cast("long").alias(c) for c in MEASURES]
    return joined.select(*(F.col("__row")[c].alias(c) for c in carry), *zero,
                         F.coalesce(F.col("__measures")["groups"], F.lit("")).alias(name))
