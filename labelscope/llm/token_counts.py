"""Token counts of whole texts for a byte-level BPE vocabulary (``tokenizers`` JSON).

A single space between two visible characters always starts a new pre-token
(no pre-token of the byte-level pattern holds a space after a visible
character), so it is a token boundary in the encoding of any text around it:
a *stable* boundary. Two uses:

* Ordinary texts are cut at all stable boundaries; each distinct piece of a
  batch is encoded once and its count reused.
* Huge texts (over ``chunk_bytes``) become rows of overlapping chunks that
  different tasks encode with offsets. Neighbours are spliced at a position
  both encodings have as token start and that is a stable boundary; a chunk
  counts its tokens between its two splices. Where an overlap has no common
  stable boundary, the text is encoded again with overlaps and chunks four
  times as wide, until it aligns or is one chunk.

Defined results: null and empty texts have 0 bytes and 0 tokens; special
strings inside texts become what the library's default makes of them; repeated
rows each get their count; extra columns pass through unless named like a
result column.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelscope.llm._io import stage_table
from labelscope.llm._text import text_bytes, text_slices

#: Texts over this many bytes are encoded in overlapping chunks.
CHUNK_BYTES = 64 << 10
#: Bytes that neighbouring chunks share on each side of a cut, at first.
OVERLAP_BYTES = 1 << 10
#: Pieces a worker keeps counts for before it starts anew.
CACHE_PIECES = 400_000

_BEFORE = np.zeros(256, bool)  # visible ASCII
_BEFORE[0x21:0x7F] = True
# visible ASCII, or the first byte of a character that cannot be white space
# (white space outside ASCII starts with C2, E1, E2 or E3)
_AFTER = _BEFORE.copy()
_AFTER[0xC3:0xE1] = True
_AFTER[0xE4:0xF5] = True

_LOADED: dict = {}


def _tokenizer(path: str):
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = (t, {})
    return _LOADED[path]


def stable_boundaries(data: np.ndarray) -> np.ndarray:
    """Positions of single spaces between two visible characters."""
    at = np.flatnonzero(data == 32)
    at = at[(at > 1) & (at < len(data) - 1)]
    two_byte = (data[at - 1] >= 0x80) & (data[at - 2] >= 0xC3) & (data[at - 2] <= 0xDF)
    return at[(_BEFORE[data[at - 1]] | two_byte) & _AFTER[data[at + 1]]]


def batch_counts(col: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each text of a batch."""
    tokenizer, cache = _tokenizer(path)
    data, off = text_bytes(col)
    if not len(data):
        return np.diff(off), np.zeros(len(off) - 1, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[stable_boundaries(data)] = True
    edge[off] = True
    cuts = np.flatnonzero(edge)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1,
                                   [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
    distinct = pieces.dictionary.to_pylist()
    new = [x for x in distinct if x not in cache]
    if len(cache) + len(new) > CACHE_PIECES:
        cache.clear()
        new = distinct
    got = tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in new], add_special_tokens=False)
    cache.update((x, len(e.ids)) for x, e in zip(new, got, strict=True))
    n = np.fromiter(map(cache.__getitem__, distinct), np.int64, len(distinct))
    total = np.zeros(len(cuts), np.int64)
    np.cumsum(n[np.asarray(pieces.indices)], out=total[1:])
    total = total[np.searchsorted(cuts, off)]
    return np.diff(off), np.diff(total)


def chunk_boundaries(chunk: bytes, start: int, zones: tuple[tuple[int, int], tuple[int, int]],
                     path: str) -> tuple[int, list]:
    """Encode one chunk that starts at byte ``start`` of its text; returns its
    token count and, for each zone of absolute positions, the stable token
    starts in it with the number of tokens before them."""
    tokenizer, _ = _tokenizer(path)
    data = np.frombuffer(chunk, np.uint8)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    skip = int(lead[0]) if len(lead) else len(data)  # rest of a character cut by the chunk's start
    text = chunk[skip:].decode("utf-8", "ignore") if start else chunk.decode("utf-8", "replace")
    enc = tokenizer.encode(text, add_special_tokens=False)
    chars = np.array([a for a, _ in enc.offsets], dtype=np.int64)
    n = len(chars)
    found = []
    if n:
        first = np.flatnonzero(np.append(True, chars[1:] != chars[:-1]))
        at = lead[np.minimum(chars[first], len(lead) - 1)]
        stable = np.isin(at, stable_boundaries(data))
        at, idx = at[stable] + start, first[stable]
    else:
        at = idx = np.zeros(0, np.int64)
    for lo, hi in zones:
        inside = (at >= lo) & (at <= hi)
        found.append((at[inside], idx[inside]))
    return n, found


def _chunk_counts(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """One row per text key: token count, and whether all splices aligned."""
    size = F.octet_length("text")
    last = F.greatest(F.ceil(size / F.lit(chunk)), F.lit(1)).cast("long") - 1
    rows = texts.select("key", F.col("text"), last.alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i"))
    begin = F.greatest(F.col("i") * chunk - overlap, F.lit(0)).cast("long")
    length = (F.when(F.col("i") == F.col("last"), F.lit(2**31 - 1))
              .otherwise((F.col("i") + 1) * chunk + overlap - begin)).cast("int")
    rows = rows.select("key", "i", "last", begin.alias("begin"),
                       F.substring("text", (begin + 1).cast("int"), length).alias("chunk"))
    spread = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("i", pa.int64()), ("last", pa.int64()), ("n", pa.int64()),
                            *((k, pa.list_(pa.int64())) for k in ("lpos", "lidx", "rpos", "ridx"))])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                zones = tuple((at * chunk - overlap, at * chunk + overlap) for at in (r["i"], r["i"] + 1))
                n, ((lp, li), (rp, ri)) = chunk_boundaries(bytes(r["chunk"]), r["begin"], zones, path)
                out.append({"key": r["key"], "i": r["i"], "last": r["last"], "n": n, "lpos": lp.tolist(),
                            "lidx": li.tolist(), "rpos": rp.tolist(), "ridx": ri.tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    found = rows.repartition(spread, "key", "i").mapInArrow(
        encode, "key string, i long, last long, n long, lpos array<long>, lidx array<long>, rpos array<long>, ridx array<long>")
    w = Window.partitionBy("key").orderBy("i")
    cut_left = F.array_min(F.array_intersect(F.lag("rpos").over(w), "lpos"))
    cut_right = F.array_min(F.array_intersect("rpos", F.lead("lpos").over(w)))
    at = lambda pos, idx, cut: F.element_at(idx, F.array_position(pos, cut).cast("int"))
    spliced = found.select(
        "key", "i", "last", "n", "lpos", "lidx", "rpos", "ridx", cut_left.alias("a"), cut_right.alias("b"))
    own = spliced.select(
        "key",
        F.when(F.col("i") == 0, F.lit(0)).when(F.col("a").isNotNull(), at("lpos", "lidx", F.col("a"))).alias("lo"),
        F.when(F.col("i") == F.col("last"), F.col("n")).when(F.col("b").isNotNull(), at("rpos", "ridx", F.col("b"))).alias("hi"))
    return own.groupBy("key").agg(F.sum(F.col("hi") - F.col("lo")).alias("n_tokens"),
                                  F.bool_and(F.col("lo").isNotNull() & F.col("hi").isNotNull()).alias("aligned"))


def huge_counts(texts: DataFrame, path: str, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """``(key, n_tokens)`` of distinct ``(key, text)`` rows by chunks, widening
    the overlap of texts that do not align."""
    done = None
    while True:
        tried = stage_table(_chunk_counts(texts, path, chunk, overlap), "token-chunks")
        good = tried.where("aligned").select("key", "n_tokens")
        done = good if done is None else done.unionByName(good)
        open_ = tried.where("not aligned").select("key")
        if open_.isEmpty():
            return done
        texts = texts.join(open_, "key", "left_semi")
        chunk, overlap = chunk * 4, overlap * 4


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text", limit: int | None = None,
                 carry: list[str] | None = None, chunk_bytes: int = CHUNK_BYTES,
                 overlap_bytes: int = OVERLAP_BYTES) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and, with ``limit``, ``over_limit``."""
    names = ["n_bytes", "n_tokens", "over_limit"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in names]
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    src = docs.select(*carry, text.alias("__text"))
    huge = F.octet_length("__text") > chunk_bytes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__text"):
                size, n = batch_counts(part.column(part.num_columns - 1), vocabulary)
                arrays = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(size), pa.array(n)], [*carry, *names[:2]])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__text"),
                        "n_bytes long", "n_tokens long"])
    out = src.where(~huge).mapInArrow(count, schema)
    large = src.where(huge).withColumn("__key", F.sha2("__text", 256))
    texts = large.select(F.col("__key").alias("key"), F.col("__text").alias("text")).dropDuplicates(["key"])
    counts = huge_counts(texts, vocabulary, chunk_bytes, overlap_bytes)
    large = large.join(counts.select(F.col("key").alias("__key"), F.col("n_tokens").alias("__n")), "__key")
    out = out.unionByName(large.select(*carry, F.octet_length("__text").cast("long").alias("n_bytes"),
                                       F.col("__n").alias("n_tokens")))
    return out if limit is None else out.withColumn("over_limit", F.col("n_tokens") > limit)
