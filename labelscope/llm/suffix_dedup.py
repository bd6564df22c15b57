"""Substring dedup by prefix-partitioned suffix trees.

A window is ``window`` consecutive words of one document; it repeats when the
same words also start earlier (in a smaller document, or earlier in the same).
Every word that a repeating window covers is removed; windows are judged on the
input, not on what is left.

The trees are sparse: of the suffixes, those that start at an *anchor* are
indexed, the place of the smallest hashed ``PREFIX``-word gram among those in a
window (leftmost on ties). Equal windows have their anchor at the same place,
so they meet in the same tree, and about one suffix in eight is indexed.

1. Prefix counts. All anchors are dealt by their ``PREFIX``-word prefix; a
   prefix that occurs once has no internal node, and its suffixes are dropped.
   Prefixes that a sample shows to be frequent are known to repeat and are not
   dealt (the list changes costs, never results). Of equal texts in one slice
   only the first is indexed; the others repeat as a whole.
2. Variable-length prefixes. Prefixes with at most ``GROUP`` suffixes make one
   memory-sized group each. Fuller ones are lengthened to the whole window:
   their windows are rows, reduced to the first of each slice before the
   shuffle and streamed in order after it.
3. Subtrees. A group's suffixes carry their words with the left context that
   their windows reach. Words are coded exactly, and names for runs of 1, 2, 4,
   ... words are doubled up to the window length: equal names are the internal
   nodes at that depth. In each node the first occurrence stays, the others are
   repeats, joined into spans.
4. Spans meet their texts again by document id.

Defined results: null and empty texts have no words; documents shorter than a
window lose nothing; rows that repeat id and text are one document, which does
not repeat itself by being stored twice; rows that share an id but not the text
are documents of their own, in the order of their texts' digests, and rows
without id come after all others (``remove_repeats`` sees to both; the functions
it calls take ids as they are); an empty table gives no rows; extra columns pass through unless
named like a result column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm._io import own_name, stage_table, tidy_shuffles
from labelscope.llm._text import Words, inside, mix, text_slices, window_hashes
from labelscope.operators.ranking import row_ids

WINDOW = 20
PREFIX = 6
#: Suffixes that one subtree may hold; a fuller prefix is lengthened.
GROUP = 4096
#: Context rows a task turns into subtrees at once.
ROWS_AT_ONCE = 30_000
COMMON_SAMPLE = 16
COMMON_TIMES = 3
COMMON_LIMIT = 500_000


def anchors(words: Words, window: int = WINDOW, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of a batch: ``gram`` hash at every word, the window
    starts, and the anchor place of each window (leftmost smallest gram)."""
    h = words.hashes()
    gram = window_hashes(h, prefix)
    n = len(h) - window + 1
    if n <= 0:
        return gram, np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.uint64(max(int(len(gram)).bit_length(), 1))
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = (mix(gram) & ~low) | np.arange(len(gram), dtype=np.uint64)  # ties go to the left
    width, span = window - prefix + 1, 1
    best = key
    while span * 2 <= width:  # least key of growing runs
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[: len(best) - (width - span)], best[width - span:])
    start = np.flatnonzero(inside(words.first, n, window))
    return gram, start, (best[start] & low).astype(np.int64)


def _ids(col: pa.Array) -> np.ndarray:
    """Ids as numbers; a null id is the smallest."""
    return np.asarray(col.fill_null(-(2**63)))


def prefix_rows(docs: DataFrame, common: np.ndarray | None, window: int, prefix: int) -> DataFrame:
    """``(gram, id, pos, kind)`` of ``docs(id, text)``: kind 0 an anchor, 1 an
    anchor with a listed prefix, 2 a document that repeats an earlier one of
    its slice as a whole (``pos`` is its number of words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                words, ids = Words(part.column("text")), _ids(part.column("id"))
                sizes = words.counts
                raw = part.column("text").to_pylist()
                firsts: dict[bytes, int] = {}
                copy = np.zeros(len(ids), bool)
                for i in np.argsort(ids, kind="stable").tolist():
                    if sizes[i] >= window:
                        text = b" ".join(raw[i].split())
                        j = firsts.setdefault(hashlib.blake2b(text, digest_size=16).digest(), i)
                        copy[i] = ids[i] > ids[j]
                gram, _, at = anchors(words, window, prefix)
                at = np.unique(at)
                doc = np.searchsorted(words.first, at, side="right") - 1
                keep = ~copy[doc]
                at, doc = at[keep], doc[keep]
                kind = np.zeros(len(at), np.int8)
                if common is not None and len(common):
                    k = np.minimum(np.searchsorted(common, gram[at]), len(common) - 1)
                    kind[common[k] == gram[at]] = 1
                whole = np.flatnonzero(copy)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([gram[at].view(np.int64), np.zeros(len(whole), np.int64)])),
                    pa.array(np.concatenate([ids[doc], ids[whole]])),
                    pa.array(np.concatenate([at - words.first[doc], sizes[whole]]).astype(np.int32)),
                    pa.array(np.concatenate([kind, np.full(len(whole), 2, np.int8)]))], ["gram", "id", "pos", "kind"])

    return docs.mapInArrow(run, "gram long, id long, pos int, kind byte")


def common_prefixes(docs: DataFrame, window: int, prefix: int) -> np.ndarray:
    """Hashes of the prefixes seen most often in a sample of the documents."""
    sample = docs.where(F.pmod(F.xxhash64(F.lit("common"), "id"), F.lit(COMMON_SAMPLE)) == 0)
    rows = (prefix_rows(sample, None, window, prefix).where("kind = 0").groupBy("gram").agg(F.count("*").alias("n"))
            .where(F.col("n") >= COMMON_TIMES).orderBy(F.desc("n"), "gram").limit(COMMON_LIMIT))
    got = rows.select("gram").toArrow().column("gram").to_numpy()
    return np.sort(got.astype(np.int64).view(np.uint64))


def repeated_prefixes(rows: DataFrame) -> DataFrame:
    """The rows of ``prefix_rows`` without anchors whose prefix occurs once.
    Anchors are dealt by prefix, streamed in order, and one row is held back;
    rows that need no counting are dealt evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, live = None, None
        for batch in batches:
            kind = batch.column(3).to_numpy()
            other = np.flatnonzero(kind != 0)
            if len(other):
                yield batch.take(pa.array(other))
                batch = batch.take(pa.array(np.flatnonzero(kind == 0)))
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                held = None
            g = batch.column(0).to_numpy()
            same = g[1:] == g[:-1]
            keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            if live is not None:
                keep |= (g == live)
            live = g[-1] if keep[-1] else None
            if not keep[-1]:
                held = batch.slice(len(g) - 1, 1)
            at = np.flatnonzero(keep)
            if len(at):
                yield batch.take(pa.array(at))

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    route = F.when(F.col("kind") == 0, F.col("gram")).otherwise(F.xxhash64("id", "pos"))
    return (rows.repartition(parts, route).sortWithinPartitions("kind", "gram")
            .mapInArrow(run, "gram long, id long, pos int, kind byte"))


def node_names(code: np.ndarray, depth: int) -> np.ndarray:
    """Names of the runs of ``depth`` codes that start at each place (equal runs,
    equal names; places near the end wrap on padding): doubling, then one
    overlapping step."""
    n = len(code)
    name, span = code.astype(np.int64), 1

    def pair(left: np.ndarray, shift: int) -> np.ndarray:
        right = np.full(n, -1, np.int64)
        right[: max(n - shift, 0)] = left[shift:]
        return np.unique(left * (n + 2) + right + 1, return_inverse=True)[1]

    if n and int(name.max(initial=0)) > n:
        name = np.unique(name, return_inverse=True)[1]
    while span * 2 <= depth:
        name, span = pair(name, span), span * 2
    return pair(name, depth - span) if span < depth else name


def context_rows(joined: DataFrame, window: int, prefix: int) -> DataFrame:
    """``(k1, k2, kind, id, start, stop, words)`` of documents with their repeated
    anchors ``(id, text, places, full)``. kind 0: a suffix of a group, with the
    words from its first window's start to its last window's end; kind 1: one
    window of a lengthened prefix; kind 2: a span known to repeat in its slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                words, ids = Words(part.column("text")), _ids(part.column("id"))
                gram, start, at = anchors(words, window, prefix)
                want = np.zeros(len(words.start) + 1, np.int8)
                lists = part.column("places")
                off = np.asarray(lists.offsets) - lists.offsets[0].as_py()
                base = np.repeat(words.first[:-1], np.diff(off))
                # several rows of one id share their places: those beyond a text are not its own
                place = np.asarray(lists.flatten()).astype(np.int64) + base
                own = place < np.repeat(words.first[1:], np.diff(off))
                want[place[own]] = 1 + np.asarray(part.column("full").flatten()).astype(np.int8)[own]
                kind = want[at]
                # runs of windows with the same anchor
                new = np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]) if len(at) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at)) - 1 if len(at) else first
                small = kind[first] == 1
                s, e = start[first[small]], start[last[small]] + window  # word ranges
                doc = np.searchsorted(words.first, s, side="right") - 1
                lo, hi = words.start[s], words.end[e - 1] if len(e) else e
                body = words.data
                text = [body[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                k1 = [gram[at[first[small]]].view(np.int64)]
                k2 = [np.zeros(len(s), np.int64)]
                kinds = [np.zeros(len(s), np.int8)]
                who, begin, end = [ids[doc]], [s - words.first[doc]], [e - words.first[doc]]
                full = np.flatnonzero(kind == 2)
                if len(full):
                    s = start[full]
                    doc = np.searchsorted(words.first, s, side="right") - 1
                    digest = np.array([np.frombuffer(hashlib.blake2b(
                        b" ".join(body[a:b].tobytes().split()), digest_size=16).digest(), np.int64)
                        for a, b in zip(words.start[s].tolist(), words.end[s + window - 1].tolist(), strict=True)])
                    order = np.lexsort((s - words.first[doc], ids[doc], digest[:, 1], digest[:, 0]))
                    d, i, p = digest[order], ids[doc][order], (s - words.first[doc])[order]
                    again = np.concatenate([[False], (d[1:] == d[:-1]).all(axis=1)])
                    head = np.flatnonzero(~again)[np.cumsum(~again) - 1]
                    again &= (i != i[head]) | (p != p[head])
                    runs = _runs(i[again], p[again], window)  # one span for neighbouring windows
                    i, p, d = i[~again], p[~again], d[~again]
                    ri, rp, rq = (c.to_numpy().astype(np.int64) for c in runs.columns)
                    k1 += [d[:, 0], ri]
                    k2 += [d[:, 1], rp]
                    kinds += [np.full(len(p), 1, np.int8), np.full(len(rp), 2, np.int8)]
                    who += [i, ri]
                    begin += [p, rp]
                    end += [p + window, rq]
                    text += [None] * (len(p) + len(rp))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(k1)), pa.array(np.concatenate(k2)), pa.array(np.concatenate(kinds)),
                    pa.array(np.concatenate(who)), pa.array(np.concatenate(begin).astype(np.int32)),
                    pa.array(np.concatenate(end).astype(np.int32)), pa.array(text, pa.binary())],
                    ["k1", "k2", "kind", "id", "start", "stop", "words"])

    return joined.mapInArrow(run, "k1 long, k2 long, kind byte, id long, start int, stop int, words binary")


def _runs(ids: np.ndarray, at: np.ndarray, window: int) -> pa.RecordBatch:
    """Window starts, in order within an id, as spans ``(id, start, stop)``."""
    order = np.lexsort((at, ids))
    ids, at = ids[order], at[order]
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (at[1:] > at[:-1] + window)]) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    return pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(at[first].astype(np.int32)),
                                       pa.array((at[last] + window).astype(np.int32))], ["id", "start", "stop"])


def subtree_spans(table: pa.Table, window: int) -> pa.RecordBatch:
    """Repeats of whole groups of suffixes: all occurrences but the first of
    every internal node at the window's depth."""
    words = Words(table.column("words").combine_chunks() if isinstance(table.column("words"), pa.ChunkedArray) else table.column("words"))
    code, _ = words.encode()
    name = node_names(code, window)
    at = np.flatnonzero(inside(words.first, len(code) - window + 1, window))
    row = np.searchsorted(words.first, at, side="right") - 1
    ids = table.column("id").to_numpy()[row]
    place = table.column("start").to_numpy()[row] + at - words.first[row]
    node = name[at]
    order = np.lexsort((place, ids, node))
    node, ids, place = node[order], ids[order], place[order]
    new = np.concatenate([[True], node[1:] != node[:-1]]) if len(node) else np.zeros(0, bool)
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(node) else node
    again = (ids != ids[head]) | (place != place[head])
    return _runs(ids[again], place[again], window)


def tree_spans(rows: DataFrame, window: int) -> DataFrame:
    """``(id, start, stop)`` of all repeats, from ``context_rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        first = None  # of the current lengthened prefix: key, id, place
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            known = np.flatnonzero(kind == 2)
            if len(known):
                yield batch.select(["id", "start", "stop"]).take(pa.array(known))
            one = np.flatnonzero(kind == 1)
            if len(one):  # streamed in order: the first row of a key is its first occurrence
                k1, k2, ids, at = (batch.column(c).to_numpy()[one] for c in ("k1", "k2", "id", "start"))
                new = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
                head = np.flatnonzero(new)[np.cumsum(new) - 1]
                hid, hat = ids[head], at[head]
                if first is not None and first[0] == (k1[0], k2[0]):
                    mine = head == 0
                    hid, hat = np.where(mine, first[1], hid), np.where(mine, first[2], hat)
                first = ((k1[-1], k2[-1]), hid[-1], hat[-1])
                again = (ids != hid) | (at != hat)
                yield _runs(ids[again], at[again].astype(np.int64), window)
            tree = np.flatnonzero(kind == 0)
            if len(tree):
                held.append(batch.take(pa.array(tree)))
                size += len(tree)
            if size >= ROWS_AT_ONCE:
                table = pa.Table.from_batches(held).combine_chunks()
                key = table.column("k1").to_numpy()
                cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
                if cut:
                    yield subtree_spans(table.slice(0, cut).combine_chunks(), window)
                    held = table.slice(cut).combine_chunks().to_batches()
                    size = table.num_rows - cut
        if size:
            yield subtree_spans(pa.Table.from_batches(held).combine_chunks(), window)

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # all windows of a lengthened prefix, in order; a group's suffixes together
    return (rows.repartition(parts, "k1", "k2").sortWithinPartitions("kind", "k1", "k2", "id", "start")
            .mapInArrow(run, "id long, start int, stop int"))


def repeat_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 prefix: int = PREFIX) -> DataFrame:
    """``(id, start, stop)``: word spans of the repeats; spans may overlap."""
    tidy_shuffles(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    common = common_prefixes(src, window, prefix)
    rows = stage_table(repeated_prefixes(prefix_rows(src, common, window, prefix)), "repeated-prefixes")
    found = rows.where("kind < 2").select("gram", "id", "pos")
    whole = rows.where("kind = 2").select("id", F.lit(0).alias("start"), F.col("pos").alias("stop"))
    full = stage_table(found.groupBy(F.col("gram").alias("g")).agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("g"), "full-prefixes")
    marked = found.join(full, F.col("gram") == F.col("g"), "left").select("id", "pos", F.col("g").isNotNull().alias("is_full"))
    lists = marked.groupBy(F.col("id").alias("pid")).agg(F.sort_array(F.collect_list(F.struct("pos", "is_full"))).alias("x"))
    joined = src.join(lists, F.col("id").eqNullSafe(F.when(F.col("pid") != -(2**63), F.col("pid")))).select(
        "id", "text", F.col("x.pos").alias("places"), F.col("x.is_full").alias("full"))
    spans = tree_spans(context_rows(joined, window, prefix), window)
    return stage_table(spans.unionByName(whole), "repeat-spans")


def with_row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` and the column that tells its documents apart: ``id_col`` where
    every row has an id of its own, else a number by id, then text (rows without
    id last). Rows that repeat id and text are one document."""
    ids = docs.groupBy(F.col(id_col).alias("i")).agg(F.count("*").alias("n")).where("n > 1 or i is null")
    if ids.isEmpty():
        return docs, id_col
    key, digest = own_name("__row", docs.columns), F.sha2(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")), 256)
    rows = docs.select(F.col(id_col).isNull().alias("o"), F.col(id_col).alias("i"), F.concat(F.isnull(text_col).cast("string"), digest).alias("h"))
    numbered = row_ids(rows.distinct(), "o", ["i", "h"], out="r").select(F.col("i").alias("__i"), F.col("h").alias("__h"), F.col("r").alias(key))
    marked = docs.select(F.struct(*docs.columns).alias("__doc"), F.col(id_col).alias("__id"),
                         F.concat(F.isnull(text_col).cast("string"), digest).alias("__hash"))
    found = marked.join(numbered, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h")))
    return stage_table(found.select(*(F.col("__doc")[c].alias(c) for c in docs.columns), key), "suffix-documents"), key


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
                   digest: bool = False, untouched: bool = False, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """``repeat_spans`` and ``remove_spans`` of documents whose ids may repeat or be null."""
    carry = docs.columns if carry is None else carry
    keyed, key = with_row_key(docs, id_col, text_col)
    return remove_spans(keyed, repeat_spans(keyed, key, text_col, window, prefix), key, text_col, carry, digest, untouched)


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 carry: list[str] | None = None, digest: bool = False, untouched: bool = False) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and what is left: ``kept_text`` (the
    kept words joined by one space), or with ``digest`` its ``kept_sha256``. With
    ``untouched``, a text that loses no word stays byte for byte as it is."""
    last = "kept_sha256" if digest else "kept_text"
    names = ["n_words", "n_removed", last]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in names]
    lists = spans.groupBy(F.col("id").alias("__sid")).agg(
        F.collect_list("start").alias("__starts"), F.collect_list("stop").alias("__stops"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    src = docs.select(*carry, key.alias("__id"), F.col(text_col).cast("binary").alias("__text"))
    src = src.join(lists, F.col("__id") == F.col("__sid"), "left").select(*carry, "__starts", "__stops", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__text"):
                k = part.num_columns
                words = Words(part.column(k - 1))
                cover = np.zeros(len(words.start) + 1, np.int32)
                starts, stops = part.column(k - 3), part.column(k - 2)
                rows = np.flatnonzero(np.asarray(starts.is_valid()))
                for i in rows.tolist():
                    a, b = (np.minimum(np.asarray(x[i].values) + words.first[i], words.first[i + 1]) for x in (starts, stops))
                    np.add.at(cover, a, 1)
                    np.add.at(cover, b, -1)
                gone = np.cumsum(cover[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[words.first[1:]] - total[words.first[:-1]]
                raw = part.column(k - 1)
                out = []
                for i in range(words.docs):
                    if not removed[i]:
                        text = raw[i].as_py()
                        text = text if untouched else b" ".join((text or b"").split())
                    else:
                        s, e = words.first[i], words.first[i + 1]
                        at = s + np.flatnonzero(~gone[s:e])
                        text = b" ".join([words.data[a:b].tobytes() for a, b in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)])
                    out.append(hashlib.sha256(text).hexdigest() if digest else text)
                kept = pa.array(out, pa.string() if digest else pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(k - 3)), pa.array(words.counts), pa.array(removed), kept],
                                                 [*carry, *names])

    own = (f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*carry).schema)
    schema = ", ".join([*own, "n_words long", "n_removed long", f"{last} {'string' if digest else 'binary'}"])
    out = src.mapInArrow(run, schema)
    return out if digest else out.withColumn(last, F.col(last).cast("string"))
