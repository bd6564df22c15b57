"""Fixed-length text encoding.

Vocabulary: whitespace tokens of the whole corpus counted by a partial +
final aggregate, top ``size`` by (count desc, token) -> ids from 2 (0 = pad,
1 = unknown). Encoding is row by row without a shuffle: the JVM splits and
truncates each text, and Arrow batches look the flat tokens up in the
vocabulary, whose rows and bytes are checked before it goes to the tasks.
Of a vocabulary with more bytes the most frequent tokens go there; tokens that
are not among them are joined by token with the rest. Those are the rare ones,
so no key of that join is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions.text import tokens
from labelscope.session import stage_table

PAD_ID = 0
UNK_ID = 1
#: Token bytes of a vocabulary that tasks may hold (a token can be any text
#: without white space, so a row bound alone says nothing).
VOCABULARY_BYTES = 64 << 20


def vocabulary(df: DataFrame, text_col: str = "code", size: int = 5000) -> DataFrame:
    """(token, id, count): the ``size`` most frequent tokens over whole texts."""
    counts = (df.select(F.explode(tokens(text_col)).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("count")))
    top = counts.orderBy(F.desc("count"), F.asc("token")).limit(size)
    w = Window.orderBy(F.desc("count"), F.asc("token"))  # <= size rows
    return top.select("token", (F.row_number().over(w) + UNK_ID).cast("int").alias("id"),
                      F.col("count").cast("bigint").alias("count"))


def _held(vocab: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """The tokens that tasks hold, and whether these are all: without counts the
    whole vocabulary, else tokens counted at least a power of two (the smallest
    that keeps their bytes within ``limit``)."""
    size = vocab.agg(F.sum(F.octet_length("token"))).first()[0] or 0
    if size <= limit:
        return vocab, True
    if "count" not in vocab.columns:
        raise ValueError(f"the vocabulary's tokens take {size} bytes, over {limit}: pass it with its counts")
    level = F.length(F.conv(F.greatest(F.col("count"), F.lit(0)).cast("string"), 10, 2))
    sizes = {r["level"]: r["n"] for r in vocab.groupBy(level.alias("level")).agg(F.sum(F.octet_length("token")).alias("n")).collect()}
    total, floor = 0, 65
    for at in sorted(sizes, reverse=True):  # <= 64 levels
        if total + sizes[at] > limit:
            break
        total, floor = total + sizes[at], at
    return vocab.where(level >= floor), False


def encode(df: DataFrame, vocab: DataFrame, key: str, text_col: str = "code",
           max_length: int = 512, vocabulary_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """(key, input_ids, attention_mask): first ``max_length`` tokens mapped to
    ids (unknown = 1), right-padded with 0; mask 1 for kept tokens. One output
    row per input row, also where keys repeat. Of a vocabulary over
    ``vocabulary_bytes`` the rare part is joined (it needs the ``count`` column)."""
    L = int(max_length)
    vocab = stage_table(vocab.select("token", "id", *(["count"] if "count" in vocab.columns else [])), "vocabulary")
    held, whole = _held(vocab, vocabulary_bytes)
    known = held.select("token", "id").toArrow().combine_chunks()
    words = known.column("token").combine_chunks().cast(pa.string()) if known.num_rows else pa.array([], pa.string())
    ids = np.append(np.asarray(known["id"], np.int32), UNK_ID).astype(np.int32)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            flat = lists.flatten().cast(pa.string())
            at = np.asarray(pc.fill_null(pc.index_in(flat, value_set=words), len(words)))
            row = np.repeat(np.arange(len(n)), n)
            col = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            out = np.full((len(n), L), PAD_ID, np.int32)
            mask = np.zeros((len(n), L), np.int32)
            out[row, col], mask[row, col] = ids[at], 1
            offsets = pa.array(np.arange(0, (len(n) + 1) * L, L, dtype=np.int32))
            arrays = [batch.column(0), *(pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (out, mask))]
            if not whole:  # places and texts of the tokens that are not held
                open_ = np.flatnonzero(at == len(words))
                first = pa.array(np.searchsorted(row[open_], np.arange(len(n) + 1)), pa.int32())
                arrays += [pa.ListArray.from_arrays(first, pa.array(col[open_], pa.int32())),
                           pa.ListArray.from_arrays(first, flat.take(pa.array(open_)))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "input_ids", "attention_mask", "at", "token"][: len(arrays)])

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, input_ids array<int>, attention_mask array<int>"
    src = df.select(F.col(key).alias("key"), F.slice(tokens(text_col), 1, L).alias("_toks"))
    if whole:
        return src.mapInArrow(look_up, schema).withColumnRenamed("key", key)
    rows = src.mapInArrow(look_up, schema + ", at array<int>, token array<string>")
    rows = stage_table(rows.withColumn("_row", F.monotonically_increasing_id()), "encoded")
    rare = vocab.join(held.select("token"), "token", "left_anti").select("token", "id")
    asked = rows.select("_row", F.explode(F.arrays_zip("at", "token")).alias("x")).select("_row", "x.at", "x.token")
    found = asked.join(rare, "token").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("at", "id"))).alias("_ids"))
    patched = F.transform("input_ids", lambda x, i: F.coalesce(F.element_at("_ids", i), x))
    full = rows.join(found, "_row", "left").select(
        "key", F.when(F.col("_ids").isNull(), F.col("input_ids")).otherwise(patched).alias("input_ids"), "attention_mask")
    return full.withColumnRenamed("key", key)
