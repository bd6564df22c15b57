"""Nearest neighbours by inner product with a forest of random-projection trees.

* Equal vectors are one node, which keeps its smallest ids (one more than ``k``,
  so nothing that could be listed is lost).
* Largest inner product becomes smallest angle by one more coordinate that gives
  all nodes the norm of the longest; a query has 0 there.
* Every tree is fitted in a task of its own on a bounded sample of nodes
  (``SAMPLE`` rows or ``SAMPLE_BYTES``): an inner node projects on the direction
  between two sampled vectors and splits at the median, so leaves are even
  whatever the distribution. A tree has a leaf per ``LEAF_ROWS`` nodes, up to
  ``MAX_LEAVES`` or ``MODEL_BYTES`` for the forest, which bounds the broadcast.
* Every node is put into a leaf of every tree. Leaves next to each other form bins of
  about ``BIN_ROWS`` nodes; a longer leaf is spread over several bins.
* A query takes leaves of all trees from one shared priority queue, the largest
  of the smallest margins on the way first, until the leaves taken hold
  ``budget`` nodes. It then goes once to each bin that holds such leaves, where
  exact inner products of the candidates give its best; the bins' lists merge.
* The budget is measured: for ``AUDIT`` queries the true neighbours over all
  nodes are computed, and the budget is the least for which the queue reaches
  ``recall`` of them (``LEAST_BUDGET`` at least, so small tables are searched
  whole).

Work per query is the budget, which grows with the input as far as the data are
hard for trees; beyond ``MAX_LEAVES`` leaves also with the leaves' length.

Defined results: rows whose id or vector is null, and vectors that are empty,
zero or hold null or non-finite components take no part. Repeated rows (same id
and vector) count once; rows that share an id but not the vector are rows of
their own, and only a query's own row is not its candidate. Shorter vectors are
padded with zeros. Ties go to the smaller id. Extra columns are not read. A
product that overflows is what double precision makes of it.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType
from pyspark.sql.window import Window

from labelscope.llm._io import stage_table, tidy_shuffles

TREES = 8
LEAF_ROWS = 128
MAX_LEAVES = 4096
#: Vectors that the trees are fitted on, at most, and their bytes.
SAMPLE, SAMPLE_BYTES = 32_768, 64 << 20
#: Bytes of the forest's directions, at most.
MODEL_BYTES = 64 << 20
BIN_ROWS = 16_384
#: Queries handled at once inside a bin.
BLOCK = 1024
AUDIT = 256
RECALL = 0.95
LEAST_BUDGET = 16_384
#: Candidates kept beyond k before products are summed in order, as sums taken
#: in another order may differ in the last bits.
SLACK = 4


def usable_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, key, vec)``: vectors that take part as little-endian bytes (floats
    stay floats, other numbers become doubles) under the digest of these bytes."""
    single = isinstance(df.schema[vec_col].dataType.elementType, FloatType)
    kind = "float" if single else "double"
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, col = batch.column(0), batch.column(1)
            off = np.asarray(col.offsets, np.int64)
            flat = np.array(col.values.to_numpy(zero_copy_only=False), "<f4" if single else "<f8")[off[0]: off[-1]] + 0  # no -0.0
            off = off - off[0]
            bad, some = (np.append(0, np.cumsum(x)) for x in (~np.isfinite(flat), flat != 0))
            good = (bad[off[1:]] == bad[off[:-1]]) & (some[off[1:]] > some[off[:-1]])
            good &= ~(np.asarray(ids.is_null()) | np.asarray(col.is_null()))
            rows = np.flatnonzero(good)
            vecs = [flat[off[i]: off[i + 1]].tobytes() for i in rows]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows)), pa.array([hashlib.blake2b(v, digest_size=16).digest() for v in vecs], pa.binary()),
                 pa.array(vecs, pa.binary())], ["id", "key", "vec"])

    return src.mapInArrow(clean, "id long, key binary, vec binary")


def distinct_nodes(rows: DataFrame, keep: int) -> DataFrame:
    """``(key, vec, ids)``: a row per distinct vector with its ``keep`` smallest ids."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy("id"))  # limited before the shuffle, so no key is hot
    least = rows.dropDuplicates(["key", "id"]).withColumn("rank", rank).where(F.col("rank") <= keep)
    return least.groupBy("key").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("id")).alias("ids"))


def _matrix(vecs: list, width: int, dim: int) -> np.ndarray:
    """Rows of doubles from vector bytes, padded with zeros."""
    out = np.zeros((len(vecs), dim))
    for i, v in enumerate(vecs):
        x = np.frombuffer(v, "<f4" if width == 4 else "<f8")
        out[i, :len(x)] = x
    return out


class Forest:
    """Split directions and thresholds of perfect trees (root 1, children ``2 i``
    and ``2 i + 1``, leaves from ``leaves`` on), and the rows of every leaf."""

    def __init__(self, width: int, dim: int, scale: float, longest: float, leaves: int):
        self.width, self.dim, self.scale, self.longest, self.leaves = width, dim, scale, longest, leaves
        self.normal = self.cut = self.counts = self.bins = self.spread = None
        self.n_bins, self.budget = 0, LEAST_BUDGET

    def place(self, x: np.ndarray) -> np.ndarray:
        """Nodes on the sphere of the longest vector, which has norm 1."""
        x = x / self.scale / self.longest
        return np.column_stack([x, np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))]).astype(np.float32)

    def aim(self, q: np.ndarray) -> np.ndarray:
        """Queries on the same sphere."""
        q = q / np.abs(q).max(axis=1, keepdims=True)
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        return np.column_stack([q, np.zeros(len(q))]).astype(np.float32)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each placed row in each tree."""
        out = np.empty((len(x), len(self.normal)), np.int32)
        for t in range(len(self.normal)):
            at = np.ones(len(x), np.int64)
            while len(at) and at[0] < self.leaves:
                at = 2 * at + (np.einsum("ij,ij->i", x, self.normal[t][at]) >= self.cut[t][at])
            out[:, t] = at - self.leaves
        return out

    def order(self, q: np.ndarray, budget: float) -> Iterator[list[tuple[int, int, int]]]:
        """For each aimed query the ``(tree, leaf, nodes so far)`` that it takes
        from the queue until ``budget`` nodes are reached."""
        trees, leaves = len(self.normal), self.leaves
        counts = self.counts.tolist()
        for lo in range(0, len(q), 256):
            margin = np.einsum("qd,tnd->qtn", q[lo: lo + 256], self.normal, optimize=True) - self.cut
            for row in margin:
                row = row.tolist()
                queue = [(-np.inf, t, 1) for t in range(trees)]
                taken, seen = [], 0
                while queue and seen < budget:
                    p, t, i = heapq.heappop(queue)
                    if i >= leaves:
                        if counts[t][i - leaves]:
                            seen += counts[t][i - leaves]
                            taken.append((t, i - leaves, seen))
                        continue
                    m = row[t][i]
                    heapq.heappush(queue, (max(p, -m), t, 2 * i + 1))
                    heapq.heappush(queue, (max(p, m), t, 2 * i))
                yield taken

    def set_counts(self, counts: np.ndarray, bin_rows: int) -> None:
        """Rows of each leaf; leaves are dealt to bins of about ``bin_rows`` rows."""
        self.counts = counts
        self.bins, self.spread = np.zeros(counts.shape, np.int64), np.ones(counts.shape, np.int64)
        at = 0
        for t in range(len(counts)):
            held = 0
            for leaf, c in enumerate(counts[t].tolist()):
                if held and held + c > bin_rows:
                    at, held = at + 1, 0
                self.bins[t, leaf] = at
                if c > bin_rows:
                    self.spread[t, leaf] = -(-c // bin_rows)
                    at, held = at + int(self.spread[t, leaf]), 0
                else:
                    held += c
            at += held > 0
        self.n_bins = max(at, 1)


def _fit_tree(x: np.ndarray, leaves: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions between two sampled rows, split at the median."""
    rng = np.random.default_rng(seed)
    normal, cut = np.zeros((leaves, x.shape[1]), np.float32), np.zeros(leaves, np.float32)
    parts = {1: np.arange(len(x))}
    for i in range(1, leaves):
        rows = parts.pop(i)
        n = np.zeros(x.shape[1])
        if len(rows) > 1:
            a, b = rng.choice(rows, 2, replace=False)
            n = x[a].astype(np.float64) - x[b]
        if not n.any():
            n = rng.normal(size=x.shape[1])
        normal[i] = n / np.linalg.norm(n)
        side = x[rows] @ normal[i]
        cut[i] = np.median(side) if len(rows) else 0
        parts[2 * i], parts[2 * i + 1] = rows[side < cut[i]], rows[side >= cut[i]]
    return normal, cut


def fit_forest(nodes: DataFrame, width: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 0) -> Forest:
    """The forest over staged nodes, without budget. Driver: a row of totals, the
    model and the leaf counts, all bounded by ``MODEL_BYTES`` and ``MAX_LEAVES``."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(0).to_pylist()
            dim = max(map(len, vecs), default=0) // width
            x = _matrix(vecs, width, dim)
            top = float(np.abs(x).max(initial=0))
            norm = float(np.sqrt(((x / top) ** 2).sum(axis=1)).max(initial=0)) if top else 0.0
            yield pa.RecordBatch.from_arrays([pa.array([len(vecs)]), pa.array([dim]), pa.array([top]), pa.array([norm])],
                                             ["n", "dim", "top", "norm"])

    row = nodes.select("vec").mapInArrow(totals, "n long, dim long, top double, norm double").agg(
        F.sum("n").alias("n"), F.max("dim").alias("dim"), F.max("top").alias("top"),
        F.max(F.struct(F.col("top") * F.col("norm"), "top", "norm")).alias("longest")).first()
    n, dim = row["n"] or 0, row["dim"] or 1
    scale = row["top"] or 1.0
    # the longest norm over the largest component, found without overflow
    longest = max((row["longest"]["norm"] * (row["longest"]["top"] / scale)) if n else 1.0, 1.0) * (1 + 1e-9)
    most = min(MAX_LEAVES, max(MODEL_BYTES // (trees * (dim + 1) * 4), 1))
    leaves = 1
    while leaves * 2 <= most and leaves * leaf_rows < n:
        leaves *= 2
    forest = Forest(width, dim, scale, longest, leaves)
    size = max(min(SAMPLE, SAMPLE_BYTES // (dim * 8)), 2)
    rate = min(0.9 * size / max(n, 1), 1.0) if n > size else 1.0
    sample = nodes.select("key", "vec").where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(rate * (1 << 30))).limit(size)
    sample = sample.select("key", "vec", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))

    def fit(key: tuple, group: pa.Table) -> pa.Table:
        tree = key[0].as_py()
        x = forest.place(_matrix(group.sort_by("key")["vec"].to_pylist(), width, dim))
        normal, cut = _fit_tree(x, leaves, seed * 1000 + tree)
        return pa.table({"tree": [tree], "normal": [normal.tobytes()], "cut": [cut.tobytes()]})

    fitted = stage_table(sample.groupBy("tree").applyInArrow(fit, "tree long, normal binary, cut binary"), "rp-forest").collect()
    fitted = {r["tree"]: r for r in fitted}
    forest.normal = np.stack([np.frombuffer(fitted[t]["normal"], np.float32).reshape(leaves, dim + 1) for t in sorted(fitted)]) \
        if fitted else np.zeros((0, leaves, dim + 1), np.float32)
    forest.cut = np.stack([np.frombuffer(fitted[t]["cut"], np.float32) for t in sorted(fitted)]) if fitted else np.zeros((0, leaves), np.float32)
    return forest


def _assigned(nodes: DataFrame, forest: Forest) -> DataFrame:
    """``(key, vec, ids, leaves)``: the leaf of each node in each tree."""
    model = nodes.sparkSession.sparkContext.broadcast(forest)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.value
        for batch in batches:
            leaf = f.leaf_of(f.place(_matrix(batch.column(1).to_pylist(), f.width, f.dim)))
            off = np.arange(0, leaf.size + 1, max(leaf.shape[1], 1), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(off), pa.array(leaf.ravel()))], ["key", "vec", "ids", "leaves"])

    return nodes.select("key", "vec", "ids").mapInArrow(assign, "key binary, vec binary, ids array<long>, leaves array<int>")


def leaf_counts(nodes: DataFrame, forest: Forest) -> np.ndarray:
    found = _assigned(nodes, forest).select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").agg(F.count("*").alias("n"))
    counts = np.zeros((len(forest.normal), forest.leaves), np.int64)
    for r in found.collect():  # trees x leaves rows at most
        counts[r["tree"], r["leaf"]] = r["n"]
    return counts


def audited_budget(nodes: DataFrame, queries: DataFrame, forest: Forest, k: int, recall: float = RECALL,
                   audit: int = AUDIT) -> float:
    """Nodes that the queue must give so that ``recall`` of the true neighbours
    (distinct nodes) of ``audit`` queries, compared with all nodes, is reached."""
    asked = queries.select("key", "vec").orderBy(F.xxhash64("key"), "key").limit(audit).collect()
    if not asked:
        return LEAST_BUDGET
    context = nodes.sparkSession.sparkContext
    keys = [bytes(r["key"]) for r in asked]
    sent = context.broadcast((keys, _matrix([r["vec"] for r in asked], forest.width, forest.dim)))
    model = context.broadcast(forest)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, q = sent.value
        width, dim = model.value.width, model.value.dim
        at = {key: i for i, key in enumerate(keys)}
        score, vecs = np.full((len(q), k), -np.inf), np.empty((len(q), k), object)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                raw = np.array([*part.column(1).to_pylist(), None], object)[:-1]
                s = q @ _matrix(list(raw), width, dim).T
                for j, key in enumerate(part.column(0).to_pylist()):
                    if key in at:
                        s[at[key], j] = -np.inf
                s, v = np.concatenate([score, s], axis=1), np.concatenate([vecs, np.broadcast_to(raw, s.shape)], axis=1)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                score, vecs = np.take_along_axis(s, top, 1), np.take_along_axis(v, top, 1)
        rows, cols = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(score[rows, cols]), pa.array(vecs[rows, cols].tolist(), pa.binary())],
                                         ["q", "score", "vec"])

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec"))
    near = (nodes.select("key", "vec").mapInArrow(best, "q long, score double, vec binary")
            .withColumn("rank", rank).where(F.col("rank") <= k).groupBy("q").agg(F.collect_list("vec").alias("vecs")))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, (_, q) = model.value, sent.value
        for batch in batches:
            out = []
            for i, vecs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                leaf = f.leaf_of(f.place(_matrix(vecs, f.width, f.dim)))
                seen = {(t, x): s for t, x, s in next(f.order(f.aim(q[i: i + 1]), np.inf))}
                out += [min(seen[t, x] for t, x in enumerate(row)) for row in leaf.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["nodes"])

    need = sorted(r["nodes"] for r in near.repartition("q").mapInArrow(needed, "nodes long").collect())  # audit x k at most
    if not need:
        return LEAST_BUDGET
    return max(need[max(int(np.ceil(recall * len(need))) - 1, 0)], LEAST_BUDGET)


def _top(score: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``keep`` largest of each row."""
    if score.shape[1] <= keep:
        cols = np.broadcast_to(np.arange(score.shape[1]), score.shape)
    else:
        cols = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
    return np.repeat(np.arange(len(score)), cols.shape[1]), cols.ravel()


def _ordered_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed component by component."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


class _Bin:
    """The nodes of one bin, by leaf."""

    def __init__(self, parts: list[pa.RecordBatch], forest: Forest):
        rows = pa.Table.from_batches(parts)
        leaf = np.array([x[0] for x in rows["leaves"].to_pylist()], np.int64)
        order = np.argsort(leaf, kind="stable")
        self.x = _matrix(rows["vec"].to_pylist(), forest.width, forest.dim)[order]
        keys, ids = rows["key"].to_pylist(), rows["ids"].to_pylist()
        self.keys, self.ids = [keys[i] for i in order], [ids[i] for i in order]
        self.leaf, self.first = np.unique(leaf[order], return_index=True)
        self.first = np.append(self.first, len(order))

    def search(self, keys: list, q: np.ndarray, leaves: list[list[int]], k: int) -> list[list[tuple]]:
        """The ``k + 1`` best ``(score, id, same vector)`` of each query among the rows of its leaves."""
        owner = np.repeat(np.arange(len(q)), [len(x) for x in leaves])
        at = np.searchsorted(self.leaf, np.concatenate([np.array(x, np.int64) for x in leaves]))
        order = np.argsort(at, kind="stable")
        rows, cols, scores = [], [], []
        cuts = np.searchsorted(at[order], np.arange(len(self.leaf) + 1))
        keep = k + 1 + SLACK
        for i in range(len(self.leaf)):
            who = owner[order[cuts[i]: cuts[i + 1]]]
            if len(who):
                lo, hi = self.first[i], self.first[i + 1]
                s = q[who] @ self.x[lo:hi].T
                r, c = _top(s, keep)
                rows.append(who[r])
                cols.append(c + lo)
                scores.append(s[r, c])
        if not rows:
            return [[] for _ in keys]
        rows, cols, scores = np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)
        order = np.lexsort((-scores, rows))
        rows, cols = rows[order], cols[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        rows, cols = rows[place < keep], cols[place < keep]
        exact = _ordered_products(q[rows], self.x[cols])
        found = [[] for _ in keys]
        for r, c, s in zip(rows.tolist(), cols.tolist(), exact.tolist(), strict=True):
            same = self.keys[c] == keys[r]
            found[r] += [(s, i, same) for i in self.ids[c]]
        return [sorted(f, key=lambda x: (-x[0], x[1]))[: k + 1] for f in found]


def _searched(model, k: int):
    """Streams bins: first a bin's nodes, then its queries."""
    struct = pa.struct([("neg", pa.float64()), ("id", pa.int64()), ("same", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.value
        at, held, nodes = None, [], None
        for batch in batches:
            bins, tags = (np.asarray(batch.column(i)) for i in (0, 1))
            cuts = np.flatnonzero(np.append(True, (bins[1:] != bins[:-1]) | (tags[1:] != tags[:-1])))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(bins)), strict=True):
                part = batch.slice(lo, hi - lo)
                if bins[lo] != at:
                    at, held, nodes = bins[lo], [], None
                if tags[lo] == 0:
                    held.append(part)
                    continue
                if nodes is None:
                    if not held:
                        continue
                    nodes, held = _Bin(held, f), []
                for b in range(0, part.num_rows, BLOCK):
                    block = part.slice(b, BLOCK)
                    keys = block.column(2).to_pylist()
                    q = _matrix(block.column(3).to_pylist(), f.width, f.dim)
                    found = nodes.search(keys, q, block.column(5).to_pylist(), k)
                    top = [[{"neg": -s, "id": i, "same": same} for s, i, same in x] for x in found]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(top, pa.list_(struct))], ["key", "top"])

    return run


def search_nodes(nodes: DataFrame, queries: DataFrame, forest: Forest, k: int) -> DataFrame:
    """``(key, top)`` of each query vector: structs of negative score, id and
    whether the vector is the query's, the ``k + 1`` first ones."""
    model = nodes.sparkSession.sparkContext.broadcast(forest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.value
        for batch in batches:
            keys, vecs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = {"bin": [], "key": [], "vec": [], "leaves": []}
            for key, vec, taken in zip(keys, vecs, f.order(f.aim(_matrix(vecs, f.width, f.dim)), f.budget), strict=True):
                visits: dict[int, list[int]] = {}
                for t, leaf, _ in taken:
                    for b in range(f.bins[t, leaf], f.bins[t, leaf] + f.spread[t, leaf]):
                        visits.setdefault(b, []).append(leaf)
                out["bin"] += visits
                out["leaves"] += visits.values()
                out["key"] += [key] * len(visits)
                out["vec"] += [vec] * len(visits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["bin"], pa.int64()), pa.array(out["key"], pa.binary()), pa.array(out["vec"], pa.binary()),
                 pa.array(out["leaves"], pa.list_(pa.int32()))], ["bin", "key", "vec", "leaves"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.value
        for batch in batches:
            leaf = np.asarray(batch.column(3).flatten()).reshape(batch.num_rows, -1)
            salt = np.array([int.from_bytes(k[:8], "little") for k in batch.column(0).to_pylist()], np.uint64)
            for t in range(leaf.shape[1]):
                one = leaf[:, t]
                bins = f.bins[t, one] + (salt % f.spread[t, one].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bins), batch.column(0), batch.column(1), batch.column(2),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(one) + 1, dtype=np.int32)), pa.array(one))],
                    ["bin", "key", "vec", "ids", "leaves"])

    rows = _assigned(nodes, forest).mapInArrow(deal, "bin long, key binary, vec binary, ids array<long>, leaves array<int>")
    asks = queries.select("key", "vec").mapInArrow(route, "bin long, key binary, vec binary, leaves array<int>")
    both = rows.select("bin", F.lit(0).alias("tag"), "key", "vec", "ids", "leaves").unionByName(
        asks.select("bin", F.lit(1).alias("tag"), "key", "vec", F.lit(None).cast("array<long>").alias("ids"), "leaves"))
    parts = min(forest.n_bins, max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))
    dealt = both.repartitionById(parts, F.pmod("bin", F.lit(parts)).cast("int")).sortWithinPartitions("bin", "tag")
    found = dealt.mapInArrow(_searched(model, k), "key binary, top array<struct<neg:double,id:long,same:boolean>>")
    # a list per visited bin, k + 1 entries each
    return found.groupBy("key").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("top")))), 1, k + 1).alias("top"))


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            trees: int = TREES, leaf_rows: int = LEAF_ROWS, bin_rows: int = BIN_ROWS, recall: float = RECALL, seed: int = 0,
            least_budget: int = LEAST_BUDGET) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of ``vectors`` with the
    largest inner products with each row of ``queries`` (all rows when None)."""
    tidy_shuffles(vectors.sparkSession)
    rows = usable_vectors(vectors, id_col, vec_col)
    asks = rows if queries is None else usable_vectors(queries, id_col, vec_col)
    width = 4 if isinstance(vectors.schema[vec_col].dataType.elementType, FloatType) else 8
    nodes = stage_table(distinct_nodes(rows, k + 1), "rp-nodes")
    asks = stage_table(asks.dropDuplicates(["key", "id"]), "rp-queries")
    asked = asks.groupBy("key").agg(F.first("vec").alias("vec"))
    forest = fit_forest(nodes, width, trees, leaf_rows, seed)
    forest.set_counts(leaf_counts(nodes, forest), bin_rows)
    total = int(forest.counts.sum())
    forest.budget = least_budget
    if total > least_budget:
        forest.budget = max(audited_budget(nodes, asked, forest, k, recall), least_budget)
    found = asks.select("id", "key").join(search_nodes(nodes, asked, forest, k), "key")
    others = F.filter("top", lambda x: ~(x["same"] & (x["id"] == F.col("id"))))
    ranked = found.select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("place", "one"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), F.col("one.id").alias("vec_id"), (-F.col("one.neg")).alias("score"))
