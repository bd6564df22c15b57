"""Periodic runs of words, found with a dictionary of basic factors.

For every power of two ``l`` the blocks of ``l`` words of a document get names,
equal blocks equal ones (a block of ``2 l`` is named by the pair of its halves).
A block that starts again ``p <= l`` words later, so that both lie within twice
the length, and again ``p`` words after that, is the start of an arithmetic
progression of occurrences and proposes the period ``p``; each period is taken
from the shortest blocks that are not shorter than it. A proposal is extended to
both sides while words ``p`` apart are equal, and equal results are one run.

A run is a stretch with smallest period ``p`` and at least ``max(least, times *
p)`` words that no neighbouring word extends. Within a run three occurrences of
a block of fewer than ``2 p`` words fit from its first word on when ``times`` is
4 or more, and a block of ``p`` or more words cannot start again earlier
than ``p`` words on, so every run is proposed, with its smallest period. Blocks
that occur once in their document are dropped: no longer block around them
occurs twice. Documents are handled whole; a batch holds about 2 MB of text, or
one longer document, and nothing is shuffled.

Defined results: null and empty texts have no words and no runs, and an empty
kept text; repeated rows and rows without id are judged one by one; extra
columns pass through ``carry`` unless named like a result column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm._io import own_name
from labelscope.llm._text import Words, text_slices

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a run, at least, and how often its period must fit.
LEAST, TIMES = 6, 4


def _extend(codes: np.ndarray, lo: int, hi: int, start: int, end: int, period: int) -> tuple[int, int]:
    """The longest stretch around ``start:end`` inside ``lo:hi`` whose words
    ``period`` apart are equal."""
    while start > lo and codes[start - 1] == codes[start - 1 + period]:
        start -= 1
    while end < hi and codes[end] == codes[end - period]:
        end += 1
    return start, end


def find_runs(codes: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows ``(document, start, length, period)`` of all runs, in this order;
    document ``i`` owns the word codes ``first[i]:first[i + 1]``."""
    if times < 4:
        raise ValueError("runs are proposed by three occurrences of a block: times must be 4 or more")
    n = len(codes)
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    end = np.repeat(first[1:], sizes)
    at = np.flatnonzero(np.repeat(sizes, sizes) >= least)
    key = doc[at] * (int(codes.max(initial=0)) + 1) + codes[at]
    found = []
    size = 1
    while len(at):
        order = np.argsort(key, kind="stable")
        again = key[order][1:] == key[order][:-1]  # the block has a successor, in order of position
        place = at[order]
        step = np.full(n, -1, np.int64)
        gap = place[1:] - place[:-1]
        near = again & (gap <= size) & (2 * gap > size)
        step[place[:-1][near]] = gap[near]
        i = place[:-1][near]
        i = np.sort(i[step[i + step[i]] == step[i]])  # three occurrences in progression
        if len(i):
            head = np.append(True, (i[1:] != i[:-1] + 1) | (step[i[1:]] != step[i[:-1]]) | (doc[i[1:]] != doc[i[:-1]]))
            heads = np.flatnonzero(head)
            tails = np.append(heads[1:], len(i)) - 1
            for a, b in zip(i[heads].tolist(), i[tails].tolist(), strict=True):
                p, d = int(step[a]), int(doc[a])
                s, e = _extend(codes, int(first[d]), int(first[d + 1]), a, b + 2 * p + size, p)
                if e - s >= max(least, times * p):
                    found.append((d, s - int(first[d]), e - s, p))
        # names of the blocks that occur again, then pairs of them
        named = np.zeros(len(order), bool)
        named[1:] |= again
        named[:-1] |= again
        name = np.full(n, -1, np.int64)
        name[place[named]] = np.cumsum(np.append(True, ~again))[named] - 1
        at = np.sort(place[named])
        at = at[at + 2 * size <= end[at]]
        at = at[name[at + size] >= 0]
        key = name[at] * len(order) + name[at + size]
        size *= 2
    return np.unique(np.array(found, np.int64).reshape(-1, 4), axis=0)


def repeated_words(runs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words lie in a run after its first period."""
    change = np.zeros(int(first[-1]) + 1, np.int64)
    start = first[runs[:, 0]] + runs[:, 1]
    np.add.at(change, start + runs[:, 3], 1)
    np.add.at(change, start + runs[:, 2], -1)
    return np.cumsum(change[:-1]) > 0


def periodic_runs(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None,
                  least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``carry`` columns with ``n_words``, ``runs`` (structs of start, length and
    period in words, by start, then period) and ``kept_text``: the words that no
    run repeats, joined by one space."""
    names = ("n_words", "runs", "kept_text")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in names]
    text_name = own_name("__text", carry)
    src = docs.select(*carry, F.col(text_col).cast("binary").alias(text_name))
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_name):
                words = Words(part.column(part.num_columns - 1))
                codes, _ = words.encode()
                runs = find_runs(codes.astype(np.int64), words.first, least, times)
                kept = ~repeated_words(runs, words.first)
                ends = np.zeros(len(kept) + 1, np.int64)
                np.cumsum(kept, out=ends[1:])
                left = words.tokens().cast(pa.large_binary()).filter(pa.array(kept))
                lists = pa.LargeListArray.from_arrays(pa.array(ends[words.first]), left)
                text = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string())
                rows = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(kind))
                cuts = pa.array(np.searchsorted(runs[:, 0], np.arange(words.docs + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(carry))), pa.array(words.counts, pa.int64()),
                     pa.ListArray.from_arrays(cuts, rows), text], [*carry, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[:-1]),
                        "n_words long", "runs array<struct<start:long,length:long,period:long>>", "kept_text string"])
    return src.mapInArrow(judge, schema)


def strongest(runs: Column) -> Column:
    """The run of greatest length over period, by exact comparison (the first
    of equal ones); null without runs."""
    better = lambda best, x: x["length"] * best["period"] > best["length"] * x["period"]
    return F.aggregate(runs, F.get(runs, 0), lambda best, x: F.when(better(best, x), x).otherwise(best))


def run_digests(found: DataFrame, carry: list[str]) -> DataFrame:
    """Counts, the strongest run and digests of ``periodic_runs`` rows."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    top = found.withColumn("__top", strongest(F.col("runs")))
    best = [F.col("__top")[c].alias(c) for c in ("start", "length", "period")]
    return top.select(*carry, F.size("runs").cast("long").alias("n_runs"), *best,
                      F.expr("(1000 * __top.length) div __top.period").alias("exponent_milli"),
                      F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"))


def loop_tails(id_col: str, text_col: str) -> Column:
    """The text, with a loop planted in about every tenth document: where the
    CRC-32 ``h`` of the decimal id is a multiple of ten, the words from
    ``a = h div 10 % n`` on repeat the ``p`` words from ``a``, with
    ``p = 1 + (n - a) div (3 + h div 10 % 8)``. Other texts, texts without words
    and rows without id stay as they are."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    looped = F.concat_ws(" ", F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a))
    return F.when((h % 10 == 0) & F.rlike(F.col(text_col), F.lit(WORD)), looped).otherwise(F.col(text_col))
