"""Subword encoding with a given byte-level BPE vocabulary.

The vocabulary (a ``tokenizers`` JSON file at a path that every worker can read)
is never trained here. Texts are cut into *types* (a word with its leading space,
a run of digits, marks or white space) by the vocabulary's own pattern in the
JVM; merges never cross types, so a type has the same tokens in every text.

* ``subword_types``: the types of a whole corpus, counted by a partial and a
  final aggregate, each with its tokens: what a corpus costs in tokens.
* ``subword_encode``: token arrays of fixed length, row by row without a
  shuffle. As every type has a token at least, the first ``max_length`` types hold the first
  ``max_length`` tokens; a worker merges each type once and reuses it.

``Merges`` applies the file's merges by rank. Whole texts are read; the arrays
are cut at ``max_length``, as the feature asks. Null texts have no types.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.functions.text import as_text, metadata_prefix

# Fixed value: the pattern of byte-level vocabularies, here with Unicode classes.
TYPE_PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Types whose tokens a worker remembers.
CACHE_TYPES = 500_000

_LOADED: dict[str, Merges] = {}


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary:
    printable ones for themselves, the others from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merges:
    """Merges of a byte-level BPE file, applied by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind, before = spec["model"].get("type", "BPE"), spec.get("pre_tokenizer") or {}
        if kind != "BPE" or before.get("type") != "ByteLevel" or spec.get("normalizer") or not before.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        self.ids: dict[str, int] = spec["model"]["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(left, right): n for n, (left, right) in enumerate(pairs)}
        self.letters = byte_letters()
        self.known: dict[str, list[int]] = {}

    @classmethod
    def of(cls, path: str) -> Merges:
        """The vocabulary, loaded once per worker."""
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def tokens(self, word: str) -> list[int]:
        """Token ids of one type: the pair of lowest rank is merged first, the
        leftmost of equal ones, until no pair has a rank."""
        part = [self.letters[b] for b in word.encode("utf-8")]
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        queue = [(self.rank[pair], i, *pair) for i, pair in enumerate(zip(part, part[1:])) if pair in self.rank]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if part[i] != left or j >= len(part) or part[j] != right:
                continue  # one side was merged meanwhile
            part[i], part[j], after[i] = left + right, "", after[j]
            if after[i] < len(part):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(part) and (part[a], part[b]) in self.rank:
                    heapq.heappush(queue, (self.rank[part[a], part[b]], a, part[a], part[b]))
        return [self.ids[p] for p in part if p]

    def of_types(self, words: list[str]) -> list[list[int]]:
        if len(self.known) + len(words) > CACHE_TYPES:
            self.known.clear()
        for w in words:
            if w not in self.known:
                self.known[w] = self.tokens(w)
        return [self.known[w] for w in words]


def types_of(text: str | Column) -> Column:
    """The types of a text, in order."""
    return F.regexp_extract_all(as_text(text), F.lit(TYPE_PATTERN), F.lit(0))


def subword_types(df: DataFrame, vocabulary: str, text_col: str = "code") -> DataFrame:
    """``(type, count, token_ids)`` of all texts."""
    counts = df.select(F.explode(types_of(text_col)).alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("count"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges.of(vocabulary)
        for batch in batches:
            ids = merges.of_types(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], ["type", "count", "token_ids"])

    return counts.mapInArrow(merge, "type string, count long, token_ids array<int>")


def subword_encode(df: DataFrame, vocabulary: str, key: str, text_col: str = "code", max_length: int = 512,
                   bos: int | None = None, eos: int | None = None, pad: int = 0, language_col: str | None = None) -> DataFrame:
    """``(key, input_ids, attention_mask)`` of length ``max_length``: the first
    tokens of the text between ``bos`` and ``eos`` (kept when the text is cut),
    then ``pad`` with mask 0. With ``language_col`` present, texts get the metadata prefix."""
    room = int(max_length) - (bos is not None) - (eos is not None)
    if room < 0:
        raise ValueError("max_length has no room for the marks")
    text = metadata_prefix(text_col, language_col) if language_col and language_col in df.columns else as_text(text_col)
    src = df.select(F.col(key).alias("key"), F.slice(types_of(text), 1, max(room, 1)).alias("types"))
    front, back = [] if bos is None else [bos], [] if eos is None else [eos]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges.of(vocabulary)
        for batch in batches:
            lists = batch.column(1)
            coded = lists.flatten().cast(pa.string()).dictionary_encode()
            ids = merges.of_types(coded.dictionary.to_pylist())
            at = np.asarray(coded.indices, np.int64)
            first = np.append(0, np.cumsum(np.asarray(pc.list_value_length(lists), np.int64)))
            out = np.full((batch.num_rows, max_length), pad, np.int32)
            mask = np.zeros((batch.num_rows, max_length), np.int32)
            for i in range(batch.num_rows):
                row = list(front)
                for k in at[first[i]: first[i + 1]]:
                    row += ids[k]
                    if len(row) >= len(front) + room:
                        break
                row = row[: len(front) + room] + back
                out[i, : len(row)], mask[i, : len(row)] = row, 1
            offsets = pa.array(np.arange(0, (batch.num_rows + 1) * max_length, max_length, dtype=np.int32)) if max_length else \
                pa.array(np.zeros(batch.num_rows + 1, np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (out, mask))],
                ["key", "input_ids", "attention_mask"])

    kind = df.schema[key].dataType.simpleString()
    found = src.mapInArrow(encode, f"key {kind}, input_ids array<int>, attention_mask array<int>")
    return found.withColumnRenamed("key", key)
