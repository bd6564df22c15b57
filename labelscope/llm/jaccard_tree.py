"""N-gram Jaccard join with signature trees.

A document's set holds its distinct shingles of five lower-cased words. Two
documents link when their sets' Jaccard similarity is at least the threshold;
the operator returns the connected components of all links.

1. One pass writes a narrow row per document: set size, 128-bit digest, a
   ``BITS``-bit bitmap of the set and four min-hashes. Equal sets become one
   class; only its smallest id goes on.
2. Near copies are gathered first: each class proposes one link, to the
   smallest class that shares most of its min-hashes; proposals are checked
   exactly on the texts. This step only saves work.
3. The exact step is a prefix filter: two sets that link share a shingle among
   the first ``n - ceil(t n) + 1`` of each, in any fixed order of shingles. The
   order puts shingles seen often in a sample of the documents last (a list of
   at most ``COMMON_LIMIT``; it changes costs, never results), then goes by
   hash. Rows (shingle, document) are dealt by shingle; a shingle counts when
   classes of different components hold it.
4. The documents of such a shingle form a signature tree: leaves are documents,
   a node holds the OR of its bitmaps, its range of set sizes and its greatest
   excess of set size over bits. A traversal of node pairs prunes those whose
   sizes cannot reach the threshold or whose greatest possible overlap,
   ``excess + popcount(OR & OR)``, is too small. Lists with the same smallest
   document go to one task, which gives each pair once with its number of
   lists; families of documents over ``BLOCK`` are dealt as pairs of blocks,
   so none is ever one task.
5. Pairs are counted over all shingles. Of two sets, the one whose prefix ends
   first shares with the other at most the shingles common to both prefixes and
   its own rest, so a pair with fewer common ones than that needs is dropped.
6. Surviving pairs are checked exactly on the texts, and all links are united.

Defined results: documents with fewer than five words have the whole sequence
as their one shingle; documents without words (null, empty) link with nothing;
repeated rows are equal sets; rows that repeat an id with another text are
linked by their own text; rows without id link by their text like others (under
a 63-bit hash of it), and their component is the smallest id among its rows,
null where none has one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm._components import components
from labelscope.llm._io import stage_table, tidy_shuffles
from labelscope.llm._text import Words, inside, mix, text_slices, window_hashes

SHINGLE = 5
PERCENT = 75
BITS = 1024
HASHES = 4
FANOUT = 8
BLOCK = 4096
#: List rows a task turns into trees at once.
ROWS_AT_ONCE = 150_000
#: One document in so many shows which shingles are common.
COMMON_SAMPLE = 16
COMMON_TIMES = 3
COMMON_LIMIT = 500_000

_SEEDS = [np.uint64(0xA0761D6478BD642F + 0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF) for k in range(HASHES + 2)]


def shingle_sets(col: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(col, lower=True)
    h = words.hashes()
    windows = window_hashes(h, size)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(windows[a: b - size + 1]))
        elif b > a:  # the whole sequence, marked with its length
            out.append(mix(window_hashes(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, n, d1, d2, bitmap, mh)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                sets = shingle_sets(part.column("text"))
                n = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                first = np.concatenate([[0], np.cumsum(n)])[:-1]
                some = np.flatnonzero(n)
                at = first[some]
                d = np.zeros((2, len(n)), np.uint64)
                low = np.zeros((len(n), HASHES), np.uint64)
                if len(some):
                    for k in range(2):
                        d[k, some] = np.add.reduceat(mix(flat ^ _SEEDS[HASHES + k]), at)
                    for k in range(HASHES):
                        low[some, k] = np.minimum.reduceat(mix(flat ^ _SEEDS[k]), at)
                maps = []
                for s in sets:
                    bits = np.zeros(BITS, bool)
                    bits[(s >> np.uint64(32)).astype(np.int64) % BITS] = True
                    maps.append(np.packbits(bits).tobytes())
                mh = pa.ListArray.from_arrays(pa.array(np.arange(0, HASHES * len(n) + 1, HASHES, dtype=np.int32)), _long(low.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), _long(d[0]), _long(d[1]), pa.array(maps, pa.binary()), mh],
                                                 ["id", "n", "d1", "d2", "bitmap", "mh"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return src.mapInArrow(run, "id long, n long, d1 long, d2 long, bitmap binary, mh array<long>")


def common_shingles(docs: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Sorted hashes of the most frequent shingles of a sample, at most ``COMMON_LIMIT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                sets = shingle_sets(part.column("text"))
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([_long(flat)], ["h"])

    sample = docs.where(F.pmod(F.xxhash64(F.lit("common"), id_col), F.lit(COMMON_SAMPLE)) == 0)
    rows = (sample.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "h long")
            .groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_TIMES)
            .orderBy(F.desc("n"), "h").limit(COMMON_LIMIT))
    got = rows.select("h").toArrow().column("h").to_numpy()
    return np.sort(got.astype(np.int64).view(np.uint64))


def prefix_rows(docs: DataFrame, id_col: str, text_col: str, common: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """``(h, id, common)``: the shingles of every document's prefix, and whether
    the shingle is on the list. Of equal sets in one slice only the smallest id
    is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = np.zeros(1 << 20, bool)
        bloom[(common >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            for part in text_slices(batch):
                seen: dict[bytes, int] = {}
                ids = part.column("id").to_pylist()
                sets = shingle_sets(part.column("text"))
                for i in sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i])):
                    if len(sets[i]):
                        seen.setdefault(sets[i].tobytes(), i)
                rows, own, flags = [], [], []
                for i in seen.values():
                    s, rare = sets[i], len(sets[i])
                    k = len(s) - -(-percent * len(s) // 100) + 1
                    maybe = np.flatnonzero(bloom[(s >> np.uint64(44)).astype(np.int64)])
                    if len(maybe):
                        at = np.searchsorted(common, s[maybe])
                        often = np.zeros(len(s), bool)
                        often[maybe] = common[np.minimum(at, len(common) - 1)] == s[maybe]
                        rare -= int(often.sum())
                        s = np.concatenate([s[~often], s[often]])
                    rows.append(s[:k])
                    flags.append(np.arange(len(rows[-1])) >= rare)
                    own.append(np.full(min(k, len(s)), -1 if ids[i] is None else ids[i], np.int64))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [_long(np.concatenate(rows)), pa.array(np.concatenate(own)), pa.array(np.concatenate(flags))], ["h", "id", "common"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return src.mapInArrow(run, "h long, id long, common boolean")


def shared_rows(rows: DataFrame) -> DataFrame:
    """Rows ``(h, id)`` whose shingle ``h`` more than one id has, without the
    repeats of a row. Rows are dealt by shingle and streamed in order; of a
    shingle that had one id so far, one row is held back. Listed shingles are
    known to be shared and are dealt evenly, so none of them gathers in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, live = None, None
        for batch in batches:
            listed = batch.column(2).to_numpy(zero_copy_only=False)
            if listed.any():
                yield batch.filter(pa.array(listed))
                batch = batch.filter(pa.array(~listed))
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                held = None
            h, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.concatenate([[True], h[1:] != h[:-1]])
            first, group = np.flatnonzero(new), np.cumsum(new) - 1
            many = np.zeros(len(first), bool)
            many[group[b != b[first][group]]] = True
            many[0] |= live is not None and h[0] == live
            keep = many[group]
            if not many[-1]:
                held = batch.slice(int(first[-1]), 1)
            live = h[-1] if many[-1] else None
            got = np.flatnonzero(keep)
            if len(got):
                yield batch.take(pa.array(got))

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    route = F.when(F.col("common"), F.xxhash64("h", "id")).otherwise(F.col("h"))
    return (rows.repartition(parts, route).sortWithinPartitions("common", "h", "id")
            .mapInArrow(run, "h long, id long, common boolean").select("h", "id"))


# --- signature trees ------------------------------------------------------------

class SignatureTree:
    """Levels of nodes over bitmaps (rows of 64-bit words) and set sizes; level 0
    holds the documents in ``order``."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, group: np.ndarray):
        self.order = np.lexsort((sizes, group))
        bits, n, g = bitmaps[self.order], sizes[self.order], group[self.order]
        excess = n - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, n, n, excess, g)]  # OR, least size, greatest size, excess, group or -1
        while len(self.levels[-1][0]) > 1:
            bits, low, high, excess, g = self.levels[-1]
            at = np.arange(0, len(bits), FANOUT)
            same = np.minimum.reduceat(g, at) == np.maximum.reduceat(g, at)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at),
                                np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at), np.where(same, g[at], -1)))


def _possible(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Node pairs that may hold linking documents of different groups."""
    bx, lx, hx, ex, gx = (v[i] for v in x)
    by, ly, hy, ey, gy = (v[j] for v in y)
    ok = (100 * hx >= percent * ly) & (100 * hy >= percent * lx) & ~((gx == gy) & (gx >= 0))
    most = np.bitwise_count(bx & by).sum(axis=1).astype(np.int64)
    overlap = np.minimum(np.minimum(ex, ey) + most, np.minimum(hx, hy))
    # 100 * overlap >= percent * (a + b - overlap) at the least sizes a, b
    return ok & ((100 + percent) * overlap >= percent * (lx + ly))


def dual_traversal(a: SignatureTree, b: SignatureTree, percent: int = PERCENT, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of document places (in each tree's input) that no bound excludes."""
    depth = max(len(a.levels), len(b.levels))
    level_a, level_b = len(a.levels) - 1, len(b.levels) - 1
    i = j = np.zeros(1, np.int64)
    for d in range(depth - 1, -1, -1):
        for tree, side in ((a, 0), (b, 1)):
            level = level_a if side == 0 else level_b
            if level > d:
                fine = len(tree.levels[d][0])
                k = (i if side == 0 else j)[:, None] * FANOUT + np.arange(FANOUT)
                ok = k < fine
                r = np.repeat(np.arange(len(i)), FANOUT)[ok.ravel()]
                k = k.ravel()[ok.ravel()]
                i, j = (k, j[r]) if side == 0 else (i[r], k)
        level_a, level_b = min(level_a, d), min(level_b, d)
        if same:
            up = i <= j if d else i < j
            i, j = i[up], j[up]
        keep = []
        for s in range(0, len(i), 200_000):
            keep.append(_possible(a.levels[level_a], b.levels[level_b], i[s: s + 200_000], j[s: s + 200_000], percent))
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        i, j = i[keep], j[keep]
    return a.order[i], b.order[j]


def small_lists(bounds: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places of the lists of up to ``most`` rows (trees of one node)."""
    start, size = bounds[:-1], np.diff(bounds)
    for k in range(2, most + 1):
        at = start[size == k]
        x, y = np.triu_indices(k, 1)
        yield (at[:, None] + x).ravel(), (at[:, None] + y).ravel()


def tree_pairs(members: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Candidate pairs ``(a, b, c)`` of ``members(h, id, comp)``, a < b, by the
    signature trees of each ``h``; ``c`` is the number of shingles whose lists
    hold both. The lists whose smallest id is the same form a family; a document
    travels once per family, with its shingles there."""
    lists = members.groupBy(F.col("h").alias("lh")).agg(F.min("id").alias("family"))
    own = (members.join(lists, F.col("h") == F.col("lh")).groupBy("family", "id")
           .agg(F.first("comp").alias("comp"), F.collect_list("h").alias("hs")))
    own = stage_table(own, "shingle-families")
    count = own.groupBy(F.col("family").alias("cf")).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("nb"))
    rows = own.join(count, F.col("family") == F.col("cf")).withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("family", F.least("blk", "other").alias("b1"), F.greatest("blk", "other").alias("b2"), "blk", "id", "comp", "hs")
    rows = rows.join(classes.select(F.col("id").alias("cid"), "n", "bitmap"), F.col("id") == F.col("cid")).drop("cid")

    def pairs(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the documents of every pair of every list."""
        family, b1, b2, n, comp, blk = (rows.column(k).to_numpy() for k in ("family", "b1", "b2", "n", "comp", "blk"))
        hs = rows.column("hs").combine_chunks()
        hs = hs.chunk(0) if isinstance(hs, pa.ChunkedArray) else hs
        h, size = np.asarray(hs.flatten()), np.diff(np.asarray(hs.offsets))
        bits = np.frombuffer(b"".join(rows.column("bitmap").to_pylist()), np.uint64).reshape(len(n), BITS // 64)
        leaves = (bits, n, n, n - np.bitwise_count(bits).sum(axis=1).astype(np.int64), comp)
        group = np.cumsum(np.concatenate([[True], (family[1:] != family[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])])) - 1
        row = np.repeat(np.arange(len(n)), size)
        order = np.lexsort((row, h, group[row]))
        row, h, g = row[order], h[order], group[row][order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
        bounds = np.append(np.flatnonzero(new), len(h))
        for i, j in small_lists(bounds, FANOUT):
            for k in range(0, len(i), 200_000):
                x, y = row[i[k: k + 200_000]], row[j[k: k + 200_000]]
                one = blk[x] + blk[y] == b1[x] + b2[x]  # of two blocks, one from each
                x, y = x[one], y[one]
                ok = _possible(leaves, leaves, x, y, percent)
                yield x[ok], y[ok]
        long = np.flatnonzero(np.diff(bounds) > FANOUT)
        for s, e in zip(bounds[long].tolist(), bounds[long + 1].tolist(), strict=True):
            at = row[s:e]
            if b1[at[0]] == b2[at[0]]:
                tree = SignatureTree(bits[at], n[at], comp[at])
                i, j = dual_traversal(tree, tree, percent, same=True)
                yield at[i], at[j]
            else:
                left, right = (at[blk[at] == v[at[0]]] for v in (b1, b2))
                if len(left) and len(right):
                    i, j = dual_traversal(*(SignatureTree(bits[k], n[k], comp[k]) for k in (left, right)), percent)
                    yield left[i], right[j]

    def counted(table: pa.Table) -> pa.RecordBatch:
        ids = table.column("id").to_numpy()
        m = table.num_rows
        codes, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def add(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            new, inverse = np.unique(np.concatenate([codes, *waiting]), return_inverse=True)
            weight = np.concatenate([times, np.ones(sum(map(len, waiting)), np.int64)])
            waiting.clear()
            return new, np.bincount(inverse, weights=weight, minlength=len(new)).astype(np.int64)

        for x, y in pairs(table):
            waiting.append(np.minimum(x, y) * m + np.maximum(x, y))
            if sum(map(len, waiting)) > 1_000_000:
                codes, times = add(codes, times)
        codes, times = add(codes, times)
        a, b = ids[codes // m], ids[codes % m]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(times)], ["a", "b", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += len(batch.column(batch.schema.get_field_index("hs")).flatten())
            if size < ROWS_AT_ONCE:
                continue
            # hold back the last group: it may go on in the next batch (two blocks at most)
            table = pa.Table.from_batches(held).combine_chunks()
            last = np.ones(table.num_rows, bool)
            for k in ("family", "b1", "b2"):
                key = table.column(k).to_numpy()
                last &= key == key[-1]
            cut = int(np.argmax(last))
            if cut:
                yield counted(table.slice(0, cut).combine_chunks())
                held = table.slice(cut).combine_chunks().to_batches()
                size = sum(len(x.column(x.schema.get_field_index("hs")).flatten()) for x in held)
        if held:
            yield counted(pa.Table.from_batches(held).combine_chunks())

    parts = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    found = rows.repartition(parts, "family", "b1", "b2").sortWithinPartitions("family", "b1", "b2").mapInArrow(run, "a long, b long, c long")
    return found.groupBy("a", "b").agg(F.sum("c").alias("c"))


def enough_common(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs whose prefixes share as many shingles as the threshold needs."""
    size = classes.select(F.col("id").alias("cid"), F.col("n").alias("cn"))
    rows = (pairs.join(size, F.col("a") == F.col("cid")).select("a", "b", "c", F.col("cn").alias("na"))
            .join(size, F.col("b") == F.col("cid")).select("a", "b", "c", "na", F.col("cn").alias("nb")))
    least = F.ceil((F.col("na") + F.col("nb")) * percent / F.lit(100 + percent))  # of a linking pair's overlap
    rest = F.ceil(F.greatest("na", "nb") * percent / F.lit(100)) - 1  # of a set after its prefix
    return rows.where(F.col("c") >= least - rest).select("a", "b")


def verify(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int = PERCENT) -> DataFrame:
    """The pairs ``(a, b)`` whose texts' sets reach the threshold, exactly."""
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    rows = pairs.join(text, F.col("a") == F.col("id")).select("a", "b", F.col("text").alias("text_a"))
    rows = rows.join(text, F.col("b") == F.col("id")).select("a", "b", "text_a", F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text_a"):
                left, right = shingle_sets(part.column("text_a")), shingle_sets(part.column("text_b"))
                ok = []
                for x, y in zip(left, right, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                at = pa.array(np.flatnonzero(ok))
                yield pa.RecordBatch.from_arrays([part.column("a").take(at), part.column("b").take(at)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def proposals(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One likely link ``(a, b)`` per class: to the smallest class sharing a
    min-hash, of those sharing at least half of them."""
    rows = classes.select("id", "n", "mh", F.posexplode("mh").alias("k", "v"))
    heads = rows.groupBy(F.col("k").alias("hk"), F.col("v").alias("hv")).agg(
        F.min(F.struct("id", "n", "mh")).alias("head"), F.count("*").alias("members")).where("members > 1")
    heads = heads.select("hk", "hv", F.col("head.id").alias("to"), F.col("head.n").alias("tn"), F.col("head.mh").alias("tmh"))
    found = rows.join(heads, (F.col("k") == F.col("hk")) & (F.col("v") == F.col("hv"))).where("to < id")
    found = found.where((100 * F.col("tn") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("tn")))
    same = F.aggregate(F.zip_with("mh", "tmh", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    found = found.select("id", "to", same.alias("same")).where(F.col("same") * 2 >= HASHES)
    best = found.groupBy("id").agg(F.min(F.struct((-F.col("same")).alias("less"), "to")).alias("best"))
    return best.select(F.col("best.to").alias("a"), F.col("id").alias("b"))


def row_key(id_col: str, text_col: str) -> F.Column:
    """The id; of rows without one, a hash of the text at or above ``2**62``."""
    return F.coalesce(F.col(id_col).cast("long"), F.shiftrightunsigned(F.xxhash64(text_col), 2) + F.lit(1 << 62))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``id, n_shingles, component_id`` of every row of ``docs``."""
    tidy_shuffles(docs.sparkSession)
    named = docs.select(row_key(id_col, text_col).alias("__key"), F.col(text_col), F.col(id_col).isNull().alias("__none"))
    out = stage_table(key_components(named, "__key", text_col, percent), "key-components")
    none = named.where("__none").select(F.col("__key").alias("nk")).distinct()
    # components with a row without id take the smallest id that is one
    out = out.join(none, F.col("__key") == F.col("nk"), "left").withColumn("id", F.when(F.col("nk").isNull(), F.col("__key")))
    mixed = out.where("id is null").select(F.col("component_id").alias("mc")).distinct()
    low = (out.join(mixed, F.col("component_id") == F.col("mc")).groupBy("mc").agg(F.min("id").alias("low")))
    out = out.join(low, F.col("component_id") == F.col("mc"), "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("mc").isNull(), F.col("component_id")).otherwise(F.col("low")).alias("component_id"))


def key_components(docs: DataFrame, id_col: str, text_col: str, percent: int = PERCENT) -> DataFrame:
    """``id, n_shingles, component_id`` of every row of ``docs``, whose ids are not null."""
    rows = stage_table(describe(docs, id_col, text_col), "sets")
    key = ["n", "d1", "d2"]
    classes = rows.where("n > 0").groupBy(*key).agg(F.min("id").alias("id"), F.first("bitmap").alias("bitmap"), F.first("mh").alias("mh"))
    classes = stage_table(classes, "set-classes")

    near = stage_table(verify(proposals(classes, percent), docs, id_col, text_col, percent), "near-links")
    first = components(near)
    classes = stage_table(classes.join(first, F.col("id") == F.col("node"), "left")
                          .select(*key, "id", "bitmap", F.coalesce("root", "id").alias("comp")), "set-components")
    of_row = stage_table(rows.join(classes.select(*(F.col(k).alias(f"c_{k}") for k in key), F.col("id").alias("rep"), "comp"),
                                   (F.col("n") == F.col("c_n")) & (F.col("d1") == F.col("c_d1")) & (F.col("d2") == F.col("c_d2")), "left")
                         .select("id", F.col("n").alias("n_shingles"), "rep", "comp"), "set-rows")

    common = common_shingles(docs, id_col, text_col)
    live = shared_rows(prefix_rows(docs, id_col, text_col, common, percent))
    named = (live.join(of_row.where("rep is not null").select(F.col("id").alias("rid"), "rep", "comp"), F.col("id") == F.col("rid"))
             .select("h", F.col("rep").alias("id"), "comp").distinct())
    named = stage_table(named, "shared-shingles")
    cross = stage_table(named.groupBy(F.col("h").alias("ch")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                        .where("lo < hi").select("ch"), "cross-shingles")
    members = stage_table(named.join(cross, F.col("h") == F.col("ch"), "left_semi"), "shingle-members")
    pairs = stage_table(enough_common(tree_pairs(members, classes, percent), classes, percent), "tree-pairs")
    links = stage_table(verify(pairs, docs, id_col, text_col, percent), "tree-links")
    # components of the first step are the nodes now
    comp = classes.select(F.col("id").alias("cid"), "comp")
    joined = (links.join(comp, F.col("a") == F.col("cid")).select(F.col("comp").alias("ca"), "b")
              .join(comp, F.col("b") == F.col("cid")).select("ca", F.col("comp").alias("cb")))
    roots = components(joined, "ca", "cb")
    out = of_row.join(roots, F.col("comp") == F.col("node"), "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("root", "comp", "id").alias("component_id"))
