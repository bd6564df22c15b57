"""Quality classifier: an interpolated modified Kneser-Ney character n-gram
model of trusted text, per-document perplexity, and thresholds that are
quantiles of each language.

A document is read as running text: a start mark, then the characters of its
words, each word closed by an end mark that stands for the space after it, so
n-grams cross from word to word. A batch is reduced to its distinct n-grams of
the highest order. Every n-gram and every context is a 64-bit key that starts
from the language, so all languages share the tables. (The functions below
``classify`` read each word on its own unless ``across`` is set.)

1. Documents are dealt into shards of about ``SHARD_BYTES`` by a hash of their
   id, as compressed blocks of rows; a shard holds documents of one of
   ``FOLDS`` folds (also by a hash of the id). A bit filter of the trusted ids
   leaves out most other documents; the shards of the rest meet the trusted ids
   in a co-group that counts n-grams; Spark adds the shards' counts up by fold.
2. Each fold has a model of the trusted documents of all other folds.
   Continuation counts, discounts (from the counts of counts of each order)
   and back-off weights are joins and aggregates of the count table.
3. Each shard asks its fold's model for its distinct keys; a join answers;
   shard and answers meet in a co-group that scores whole texts. No document
   is scored with its own counts, so trusted and other documents compare. The
   shards take ``TURNS`` turns, so that half of them lie on the disk at once.
4. The ``quantile`` of the perplexities of all trusted documents of a language,
   times ``slack``, is its threshold.

Every trusted document is counted (for the other folds) and is in its
language's quantile; nothing is sampled.

Defined results: null and empty texts have no perplexity and are kept (other
rules judge them); a null language is a language of its own; languages without
trusted text have no model, and their documents no perplexity and are kept;
where a language's trusted documents all lie in one fold, that fold has no
model, the language no threshold, and its documents are kept; repeated rows are
scored one by one; extra columns pass through unless named like a result column.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from labelscope.llm._io import discard, stage_table, tidy_shuffles
from labelscope.llm._text import Words, mix, per_doc, text_bytes, text_slices

ORDER = 5
QUANTILE = 0.995
SLACK = 1.0
#: Parts of the trusted documents; each is scored with the counts of the others.
FOLDS = 5
#: Text of one shard, and the least number of shards.
SHARD_BYTES = 48 << 20
MIN_SHARDS = 8
#: Parts of the shards that are scored one after the other.
TURNS = 2
#: Bits per trusted id in the filter before counting, and its most words of 64 bits.
FILTER_BITS = 16
FILTER_WORDS = 1 << 20
_START, _END = np.uint64(2), np.uint64(3)
_K = np.uint64(0x9E3779B97F4A7C15)


def language_key(lang: str | None) -> np.uint64:
    """Key of a language's empty context."""
    raw = np.frombuffer(("\x00" if lang is None else "l" + lang).encode("utf-8", "surrogatepass"), np.uint8)
    h = len(raw)
    for b in raw.tolist():
        h = int(mix(np.array([(h * int(_K) + b) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])
    return np.uint64(h)


def distinct(keys: np.ndarray, bits: int = 20) -> np.ndarray:
    """Distinct keys, in no order, by rounds of scattering into a table."""
    out = []
    slots = np.zeros(1 << bits, np.int64)
    while len(keys):
        at = (keys >> np.uint64(64 - bits)).astype(np.int64)
        slots[at] = np.arange(len(keys))
        winner = slots[at]
        out.append(keys[winner == np.arange(len(keys))])
        keys = keys[keys != keys[winner]]
    return np.concatenate(out) if out else keys


class Lookup:
    """Positions of 64-bit keys in a fixed key list (-1: absent), by linear probing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(4 * max(len(keys), 1)))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.where = np.full(1 << bits, -1, np.int64)
        self.keys = keys
        left, step = np.arange(len(keys)), 0
        while len(left):
            at = ((keys[left] >> self.shift).astype(np.int64) + step) & self.mask
            free = self.where[at] < 0
            self.where[at[free]] = left[free]
            left = left[self.where[at] != left]
            step += 1
        self.steps = step

    def find(self, keys: np.ndarray) -> np.ndarray:
        base = (keys >> self.shift).astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for step in range(self.steps):
            got = self.where[(base[open_] + step) & self.mask]
            some = got >= 0
            open_, got = open_[some], got[some]
            same = self.keys[got] == keys[open_]
            out[open_[same]] = got[same]
            open_ = open_[~same]
            if not len(open_):
                break
        return out


def word_symbols(dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the words (start mark, characters, end mark) and each word's first."""
    raw, off = text_bytes(dictionary)
    try:
        chars = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        first = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off]
    except UnicodeDecodeError:  # bytes stand for themselves
        chars, first = raw.astype(np.uint32), off
    words = len(first) - 1
    chars = np.insert(chars.astype(np.uint64) + np.uint64(4), first[1:], _END)
    first = first + np.arange(words + 1)
    chars = np.insert(chars, first[:-1], _START)
    return chars, first + np.arange(words + 1)


def text_symbols(words: Words, across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the texts (``across``: one start mark a text, else one a word),
    the number of each since its start mark, and each text's first symbol."""
    if across:
        return _running_symbols(words)
    symbols, first = word_symbols(words.tokens())
    off = first[words.first]
    here = np.arange(len(symbols))
    return symbols, here - np.maximum.accumulate(np.where(symbols == _START, here, 0)), off


def _running_symbols(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text_symbols`` of running text. No word holds a tab or a space, so they
    stand for the marks until the bytes are decoded."""
    raw, ends = text_bytes(words.tokens())
    some = np.flatnonzero(words.counts > 0)
    raw = np.insert(raw, ends[1:], np.uint8(32))
    ends = ends + np.arange(len(ends))  # of the words with their end marks
    raw = np.insert(raw, ends[words.first[some]], np.uint8(9))
    lead = np.zeros(words.docs + 1, np.int64)
    lead[some + 1] = 1
    off = ends[words.first] + np.cumsum(lead)
    try:
        if len(raw) and raw.max() >= 128:
            chars = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            length = np.zeros(words.docs + 1, np.int64)
            length[some + 1] = np.add.reduceat((raw & 0xC0) != 0x80, off[some], dtype=np.int64)
            off = np.cumsum(length)
        else:
            chars = raw
    except UnicodeDecodeError:  # bytes stand for themselves
        chars = raw
    symbols = chars.astype(np.uint64)
    symbols += np.uint64(4)
    symbols[chars == 32] = _END
    symbols[off[some]] = _START
    since = np.arange(len(symbols))
    since -= np.repeat(off[:-1], np.diff(off))
    return symbols, since, off


def distinct_grams(symbols: np.ndarray, j: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every place but the start marks: the code of the ``order`` symbols (or
    those since the start mark) that end there; and a place of each code."""
    symbols = symbols.view(np.int64)
    kinds = np.flatnonzero(np.bincount(symbols))
    small = np.zeros(int(kinds[-1]) + 1, np.int64)
    small[kinds] = np.arange(1, len(kinds) + 1)
    small = small[symbols]
    bits = len(kinds).bit_length()
    if bits * order <= 63:
        window, have = small.copy(), 1
        while have < order:  # of ``have`` symbols; longer ones from two that touch
            more = min(have, order - have)
            tail = small if more == 1 else window & ((1 << bits * more) - 1)
            window[have:] |= tail[: max(len(small) - have, 0)] << bits * have
            have += more
        near = np.flatnonzero(j < order - 1)  # nothing from before the start mark
        window[near] &= (1 << bits * (j[near] + 1)) - 1
    else:
        window, used = np.zeros(len(symbols), np.int64), 0
        for n in range(order - 1, -1, -1):
            if used + bits > 63:  # a large alphabet: number the windows so far
                numbered = pa.array(window).dictionary_encode()
                window, used = np.asarray(numbered.indices).astype(np.int64), len(numbered.dictionary).bit_length()
            window <<= bits
            window[n:] |= np.where(j[n:] >= n, small[: max(len(small) - n, 0)], 0)
            used += bits
    place = np.flatnonzero(j)
    coded = pa.array(window[place]).dictionary_encode()
    code = np.asarray(coded.indices)
    at = np.zeros(len(coded.dictionary), np.int64)
    at[code] = place
    return code, at


def gram_keys(symbols: np.ndarray, at: np.ndarray, root: np.uint64, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """``keys[n]``: keys of the ``n`` symbols that end at the places ``at`` (valid
    while they reach back to the start mark at most); ``contexts[n]``: of all
    but the last of them. ``keys[0]`` is the empty context."""
    c = [symbols[np.maximum(at - k, 0)] * np.uint64(0xD6E8FEB86659FD93) for k in range(order)]
    keys, contexts = [np.full(len(at), root, np.uint64)], [np.full(len(at), root, np.uint64)]
    for n in range(1, order + 1):
        key = keys[0]
        for k in range(n - 1, -1, -1):
            before, key = key, mix(key * _K + c[k] + np.uint64(n - k))
        keys.append(key)
        contexts.append(before)
    return keys, contexts


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str | None, np.ndarray]]:
    lang = batch.column(batch.schema.get_field_index("__lang"))
    for value in lang.unique().to_pylist():
        mask = pc.is_null(lang) if value is None else pc.fill_null(pc.equal(lang, value), False)
        yield value, np.flatnonzero(np.asarray(mask))


# --- shards ------------------------------------------------------------------

def shard_of(col: str, shards: int, folds: int = 1, spread: str | None = None) -> F.Column:
    """``shards`` is a multiple of ``folds``; a row's fold is its shard modulo
    ``folds`` and does not depend on ``shards``. Rows without id (never trusted)
    are dealt by the column ``spread``."""
    hashed = lambda name: F.xxhash64(F.lit(name), F.col(col))
    if spread is not None:
        hashed = lambda name: F.when(F.col(col).isNotNull(), F.xxhash64(F.lit(name), F.col(col))).otherwise(F.xxhash64(F.lit(name), F.col(spread)))
    part = lambda name, n: F.pmod(hashed(name), F.lit(n).cast("long")).cast("int")
    return part("shard", shards) if folds == 1 else part("shard", shards // folds) * folds + part("fold", folds)


def shard_blocks(docs: DataFrame, id_col: str, lang_col: str, text_col: str, carry: list[str], shards: int,
                 folds: int = 1, turn: tuple[int, int] = (0, 1)) -> DataFrame:
    """``(shard, block)``: rows ``(carry..., __id, __lang, __text)`` of each batch and
    shard as one compressed Arrow stream, one shard a partition. Text shrinks to
    about a third, so the shuffle that brings shards together stays small.
    ``turn=(k, n)``: only the ``k``-th of ``n`` parts of the shards of every fold."""
    src = docs.select(*carry, F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.col(text_col).cast("binary").alias("__text"),
                      shard_of(id_col, shards, folds, text_col).alias("__shard"))
    if turn[1] > 1:
        src = src.where(F.expr(f"(__shard div {folds}) % {turn[1]} = {turn[0]}"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        for batch in batches:
            for part in text_slices(batch, "__text", 32 << 20):
                where = np.asarray(part.column(part.num_columns - 1))
                rows = part.select(part.schema.names[:-1])
                order = np.argsort(where, kind="stable")
                kinds, first = np.unique(where[order], return_index=True)
                for shard, at in zip(kinds.tolist(), np.split(order, first[1:]), strict=True):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
                        writer.write_batch(rows.take(pa.array(at)))
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                                     ["shard", "block"])

    return src.mapInArrow(pack, "shard int, block binary").repartitionById(shards, "shard")


def unpack(block: pa.Scalar) -> Iterator[pa.RecordBatch]:
    for batch in pa.ipc.open_stream(block.as_buffer()):
        yield from text_slices(batch, "__text")


def maybe_trusted(docs: DataFrame, id_col: str, trusted: DataFrame) -> DataFrame:
    """``docs`` without most rows whose id is not in ``trusted(id)``, and with all
    whose id is. Every trusted id sets a bit, out of ``FILTER_BITS`` per id,
    in words of 64 bits; the words (at most ``FILTER_WORDS``) are broadcast."""
    words = max(1, min(FILTER_WORDS, trusted.count() * FILTER_BITS // 64))
    bit = lambda col: F.pmod(F.xxhash64(F.lit("trusted"), F.col(col)), F.lit(64 * words))
    held = (trusted.select(bit("id").alias("bit")).groupBy(F.expr("bit div 64").alias("__word"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("__held")))
    asked = docs.withColumn("__bit", bit(id_col)).withColumn("__at", F.expr("__bit div 64"))
    here = asked.join(F.broadcast(held), F.col("__at") == F.col("__word"))
    return here.where(F.call_function("getbit", "__held", (F.col("__bit") % 64).cast("int")) == 1).select(*docs.columns)


# --- model -------------------------------------------------------------------

def count_ngrams(blocks: DataFrame, trusted: DataFrame, order: int, across: bool = False, folds: int = 1) -> DataFrame:
    """``(key, ord, ctx, suf, bos, c, c0...)`` of the documents whose id is in
    ``trusted(shard, id)``: all counts, and those of each fold."""
    names = ["key", "ord", "ctx", "suf", "bos", "c", "fold"]
    kinds = pa.schema([("key", pa.int64()), ("ord", pa.int32()), ("ctx", pa.int64()), ("suf", pa.int64()), ("bos", pa.bool_()), ("c", pa.int64()),
                       ("fold", pa.int32())])

    def count(docs: pa.Table, trusted: pa.Table) -> pa.Table:
        out: list[pa.RecordBatch] = []
        ids = trusted.column("id").combine_chunks() if trusted.num_rows else None
        fold = trusted.column("shard")[0].as_py() % folds if trusted.num_rows else 0
        for block in docs.column("block") if ids is not None else ():
            for part in unpack(block):
                part = part.filter(pc.is_in(part.column(part.schema.get_field_index("__id")), value_set=ids, skip_nulls=True))
                for lang, rows in _by_language(part):
                    words = Words(part.column(part.schema.get_field_index("__text")).take(pa.array(rows)))
                    if not len(words.start):
                        continue
                    symbols, since, _ = text_symbols(words, across)
                    code, at = distinct_grams(symbols, since, order)
                    times, j = np.bincount(code), since[at]
                    keys, contexts = gram_keys(symbols, at, language_key(lang), order)
                    for n in range(1, order + 1):
                        rows = np.flatnonzero(j >= n - 1)
                        key, k, inverse = np.unique(keys[n][rows], return_index=True, return_inverse=True)
                        c = np.bincount(inverse, weights=times[rows]).astype(np.int64)
                        one = rows[k]
                        out.append(pa.RecordBatch.from_arrays([
                            pa.array(key.view(np.int64)), pa.array(np.full(len(key), n, np.int32)),
                            pa.array(contexts[n][one].view(np.int64)), pa.array(keys[n - 1][one].view(np.int64)),
                            pa.array(j[one] == n - 1), pa.array(c), pa.array(np.full(len(key), fold, np.int32))], names))
                if len(out) > 64:
                    out = _added(out, kinds)
        return pa.Table.from_batches(_added(out, kinds) if out else [], schema=kinds)

    rows = blocks.groupBy("shard").cogroup(trusted.groupBy("shard")).applyInArrow(
        count, "key long, ord int, ctx long, suf long, bos boolean, c long, fold int")
    # a key has one order, context and suffix; grouped by them, rows are narrower than with a first value of each
    grams = rows.groupBy("key", "ord", "ctx", "suf", "bos")
    if folds == 1:
        return grams.agg(F.sum("c").alias("c"))
    by_fold = [F.sum(F.when(F.col("fold") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(folds)]
    every = sum((F.col(f"c{k}") for k in range(1, folds)), F.col("c0"))
    return grams.agg(*by_fold).select("key", "ord", "ctx", "suf", "bos", every.alias("c"), *(f"c{k}" for k in range(folds)))


def _added(batches: list[pa.RecordBatch], kinds: pa.Schema) -> list[pa.RecordBatch]:
    """Counts of equal keys added up."""
    table = pa.Table.from_batches(batches)
    key, first, inverse = np.unique(table.column("key").to_numpy(), return_index=True, return_inverse=True)
    c = np.bincount(inverse, weights=table.column("c").to_numpy()).astype(np.int64)
    table = table.take(pa.array(first)).set_column(5, "c", pa.array(c))
    return table.combine_chunks().cast(kinds).to_batches()


def model_table(counts: DataFrame, order: int, folds: int = 1, drop_counts: bool = False) -> DataFrame:
    """``(key, alpha, gamma)``, staged: in arrays by model, the discounted
    probability of each seen n-gram and the back-off weight of each seen context
    (null where the model has none); the empty context's ``alpha`` is one over
    the number of symbols. Model ``k`` leaves fold ``k`` out (one fold:
    nothing). ``drop_counts`` removes the staged counts as soon as they are read."""
    models = range(folds)
    rest = [F.col("c") - F.col(f"c{k}") if folds > 1 else F.col("c") for k in models]
    follow = counts.where("ord > 1").groupBy(F.col("suf").alias("k")).agg(
        *(F.sum((c > 0).cast("long")).alias(f"left_kinds{k}") for k, c in enumerate(rest)))
    own = counts.join(follow, F.col("key") == F.col("k"), "left")
    whole = (F.col("ord") == order) | F.col("bos")
    # Kneser-Ney: below the top order, in how many contexts a gram occurs
    grams = own.select("key", "ord", "ctx", *(
        F.when(whole | (c == 0), c).otherwise(F.coalesce(f"left_kinds{k}", c)).alias(f"c{k}") for k, c in enumerate(rest)))
    grams = stage_table(grams, "kn-grams")
    if drop_counts:
        discard(counts)

    def discount(k: int, i: int, usual: float):
        n = [F.sum((F.col(f"c{k}") == j).cast("double")) for j in (1, 2, 3, 4)]
        y = F.try_divide(n[0], n[0] + 2 * n[1])
        d = F.lit(float(i)) - (i + 1) * y * F.try_divide(n[i], n[i - 1])
        return F.least(F.greatest(F.coalesce(F.when(n[0] > 0, d), F.lit(usual)), F.lit(0.05)), F.lit(float(i)))

    discounts = grams.groupBy(F.col("ord").alias("o")).agg(
        *(discount(k, i, u).alias(f"d{k}_{i}") for k in models for i, u in ((1, 0.5), (2, 1.0), (3, 1.5))))
    held = grams.join(F.broadcast(discounts), F.col("ord") == F.col("o"))  # one row per order
    for k in models:
        c = F.col(f"c{k}")
        held = held.withColumn(f"d{k}", F.when(c == 1, F.col(f"d{k}_1")).when(c == 2, F.col(f"d{k}_2")).when(c > 0, F.col(f"d{k}_3")))
    held = held.select("key", "ord", "ctx", *(f"{x}{k}" for k in models for x in "cd"))
    contexts = held.groupBy(F.col("ctx").alias("x")).agg(F.first("ord").alias("x_ord"), *(
        a for k in models for a in (F.sum(f"c{k}").alias(f"total{k}"), F.sum(f"d{k}").alias(f"held{k}"), F.count(f"d{k}").alias(f"kinds{k}"))))
    alpha = held.join(contexts.select("x", *(f"total{k}" for k in models)), F.col("ctx") == F.col("x")).select("key", *(
        F.when(F.col(f"c{k}") > 0, F.greatest(F.col(f"c{k}") - F.col(f"d{k}"), F.lit(0.0)) / F.col(f"total{k}")).cast("float").alias(f"a{k}")
        for k in models), *(F.lit(None).cast("float").alias(f"g{k}") for k in models))
    some = [F.col(f"kinds{k}") > 0 for k in models]
    gamma = contexts.select(
        F.col("x").alias("key"),
        *(F.when(some[k] & (F.col("x_ord") == 1), 1.0 / (F.col(f"kinds{k}") + 1)).cast("float").alias(f"a{k}") for k in models),
        *(F.when(some[k], F.col(f"held{k}") / F.col(f"total{k}")).cast("float").alias(f"g{k}") for k in models))
    best = alpha.unionByName(gamma).groupBy("key").agg(*(F.max(f"{x}{k}").alias(f"{x}{k}") for x in "ag" for k in models))
    model = stage_table(best.select("key", F.array(*(f"a{k}" for k in models)).alias("alpha"),
                                    F.array(*(f"g{k}" for k in models)).alias("gamma")), "kn-model")
    discard(grams)
    return model


# --- scoring -----------------------------------------------------------------

def gram_costs(j: np.ndarray, keys: list[np.ndarray], contexts: list[np.ndarray], lookup: Lookup,
               alpha: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """Negative log-probability of each gram's last symbol (interpolated from the shortest context up)."""
    p = np.full(len(j), alpha[lookup.find(keys[0][:1])[0]])
    live = np.arange(len(j))
    for n in range(1, len(keys)):
        live = live[j[live] >= n - 1]
        context = lookup.find(contexts[n][live])
        some = context >= 0
        live, g = live[some], gamma[context[some]]
        some = ~np.isnan(g)  # a context unseen has no longer context seen
        live, g = live[some], g[some]
        found = lookup.find(keys[n][live])
        p[live] = np.where(found >= 0, np.nan_to_num(alpha[found]), 0.0) + g * p[live]
    return -np.log(p)


def perplexities(blocks: DataFrame, model: DataFrame, order: int, kinds: list, across: bool = False, folds: int = 1,
                 shards: int = MIN_SHARDS) -> DataFrame:
    """``kinds`` columns (carried in the blocks) with ``n_symbols`` and
    ``perplexity`` of whole texts, by the model of the shard's fold; ``shards``
    is the blocks' number of shards, so that answers come one shard a partition too."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for shard, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                mine = want.setdefault(shard, [])
                for part in unpack(block):
                    for lang, rows in _by_language(part):
                        words = Words(part.column(part.schema.get_field_index("__text")).take(pa.array(rows)))
                        if not len(words.start):
                            continue
                        symbols, since, _ = text_symbols(words, across)
                        _, at = distinct_grams(symbols, since, order)
                        keys, contexts = gram_keys(symbols, at, language_key(lang), order)
                        j = since[at]
                        # a context is a gram that ends one place before, but for the start mark alone
                        got = [keys[0][:1], *(keys[n][j >= n - 1] for n in range(1, order + 1)), *(k[j == 1][:1] for k in contexts[2:3])]
                        mine.append(distinct(np.concatenate(got)))
                    if len(mine) >= 8:
                        mine[:] = [distinct(np.concatenate(mine))]
        for shard, mine in want.items():
            key = np.sort(distinct(np.concatenate(mine))) if mine else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), shard, np.int32)), pa.array(key.view(np.int64))], ["shard", "key"])

    asked = blocks.mapInArrow(ask, "shard int, key long")
    fold = F.col("shard") % folds
    answers = (asked.join(model, "key").select("shard", "key", F.get("alpha", fold).alias("alpha"), F.get("gamma", fold).alias("gamma"))
               .where("alpha is not null or gamma is not null").repartitionById(shards, "shard"))
    carry = [f.name for f in kinds]
    names = ["n_symbols", "perplexity"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "n_symbols long", "perplexity double"])

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        key = answers.column("key").to_numpy().view(np.uint64)
        alpha, gamma = (answers.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("alpha", "gamma"))
        lookup = Lookup(key)
        out = []
        for block in docs.column("block"):
            for part in unpack(block):
                symbols_of, result = np.zeros(part.num_rows, np.int64), np.full(part.num_rows, np.nan)
                for lang, rows in _by_language(part):
                    root = language_key(lang)
                    words = Words(part.column(part.schema.get_field_index("__text")).take(pa.array(rows)))
                    known = lookup.find(np.array([root], np.uint64))[0] >= 0
                    if not len(words.start) or not known:
                        continue
                    symbols, since, off = text_symbols(words, across)
                    code, at = distinct_grams(symbols, since, order)
                    cost = gram_costs(since[at], *gram_keys(symbols, at, root, order), lookup, alpha, gamma)
                    first = np.concatenate([[0], np.cumsum(since > 0)])[off]
                    n = np.diff(first)
                    total = per_doc(cost[code], first)
                    symbols_of[rows] = n
                    result[rows] = np.where(n > 0, np.exp(total / np.maximum(n, 1)), np.nan)
                keep = [part.column(part.schema.get_field_index(c)) for c in carry]
                out.append(pa.RecordBatch.from_arrays(
                    [*keep, pa.array(symbols_of), pa.array(result, mask=np.isnan(result))], [*carry, *names]))
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([], schema=empty)

    empty = to_arrow_schema(StructType([*kinds, StructField("n_symbols", LongType()), StructField("perplexity", DoubleType())]))
    return blocks.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(score, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text",
             trusted: str = "quality = 1", order: int = ORDER, quantile: float = QUANTILE, slack: float = SLACK,
             carry: list[str] | None = None, folds: int = FOLDS) -> DataFrame:
    """``docs`` with ``n_symbols``, ``perplexity``, ``threshold`` and ``kept``."""
    tidy_shuffles(docs.sparkSession)
    names = ["n_symbols", "perplexity", "threshold", "kept"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in names]
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    shards = folds * -(-max(MIN_SHARDS, -(-size // SHARD_BYTES)) // folds)
    ids = labels.where(trusted).select(F.col(id_col).cast(docs.schema[id_col].dataType).alias("id")).where("id is not null").distinct()
    ids = stage_table(ids.withColumn("shard", shard_of("id", shards, folds)), "kn-trusted")
    # blocks of their own: the counts need no other rows and columns
    counted = shard_blocks(maybe_trusted(docs.select(*dict.fromkeys([id_col, lang_col, text_col])), id_col, ids),
                           id_col, lang_col, text_col, [], shards, folds)
    counts = stage_table(count_ngrams(counted, ids.repartitionById(shards, "shard"), order, True, folds), "kn-counts")
    model = model_table(counts, order, folds, drop_counts=True)

    kinds = [docs.schema[c] for c in carry]
    kinds += [StructField("__id", docs.schema[id_col].dataType), StructField("__lang", docs.schema[lang_col].dataType)]
    # a turn's blocks, questions and answers are gone from the disk when the next begins
    turns = [shard_blocks(docs, id_col, lang_col, text_col, carry, shards, folds, (k, TURNS)) for k in range(TURNS)]
    scored = reduce(DataFrame.unionByName, [stage_table(perplexities(b, model, order, kinds, True, folds, shards), "kn-scores") for b in turns])
    discard(model)
    known = scored.where("perplexity is not null").join(ids.select(F.col("id").alias("__trusted")), F.col("__id") == F.col("__trusted"), "left_semi")
    cut = known.groupBy(F.col("__lang").alias("__cut_lang")).agg(F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000)).alias("__cut"))
    out = scored.join(cut, F.col("__lang").eqNullSafe(F.col("__cut_lang")), "left")
    limit = F.col("__cut") * slack
    kept = F.coalesce(F.col("perplexity") <= limit, F.lit(True))
    return out.select(*carry, "n_symbols", "perplexity", limit.alias("threshold"), kept.alias("kept"))
