"""Embedding near-duplicates: a hierarchical navigable small-world graph per
shard, queried by every vector.

1. Equal vectors are one node with a multiplicity; nodes are normalised in
   double precision and dealt into shards by hash: at least ``MIN_SHARDS``, and
   more so that a shard holds about ``SHARD_ROWS``, or fewer long vectors.
2. Each shard's graph is built in one task and staged in blocks of nodes.
3. Every shard is asked by every node. A task holds one shard's graph and
   streams blocks of queries past it; shards are asked in turns, so that few
   copies of the queries are on disk at once. A search descends the levels and
   keeps a beam on the ground level. Beams that end full of links are widened
   for those queries. Audits double the beams until their recall is ``RECALL``:
   for all queries of a task by ``PROBES`` vectors made from the shard's own
   nodes, each turned away from its node until their cosine is the threshold
   (links are audited where the data hold none), and for every ``ASK_ROWS`` of
   them by the links of ``AUDIT`` queries (against brute force). A beam as wide
   as half the shard becomes a scan of it.
4. Candidates are checked by their cosine in double precision. A task reports
   the number of links of each query, one of its links, and a spanning forest of
   the shard's nodes, so rows and memory grow with vectors, not with linked pairs.
5. These edges are united into components.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and are kept as their own component; vectors of
different lengths never link; repeated ids are one node for components, while
each of their rows counts as a vector; rows without id count and link like
others, but name no component: theirs is the smallest id reachable, or null where
no row of it has one (then the rows of one of its vectors are kept); they are not
kept in components that have an id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm._components import components
from labelscope.llm._io import discard, stage_table, tidy_shuffles
from labelscope.llm._text import mix

MIN_SHARDS = 6
SHARD_ROWS = 200_000
#: Components of all vectors of a shard, so that long vectors make more shards.
SHARD_VALUES = 16_000_000
#: Bytes of the vectors of one staged block.
BLOCK_BYTES = 1 << 17
#: Queries that are searched and audited together.
ASK_ROWS = 8192
#: Copies of queries that a turn deals out, unless one shard needs more.
TURN_ROWS = 1_000_000
#: Links of a node on the ground level, and on the others.
GROUND_LINKS, UPPER_LINKS = 24, 12
#: Further links of a node on the ground level, set when the graph is done.
RETURNED_LINKS = 24
BUILD_BEAM = 40
SEARCH_BEAM = 24
AUDIT = 48
PROBES = 1000
RECALL = 0.999
#: Entries of the visited table of one block of queries.
VISITED = 8_000_000
#: Components of vectors that are normalised at once.
SLICE_VALUES = 2_000_000


BLOCK = pa.schema([*((x, pa.int32()) for x in ("shard", "dim", "level", "block", "start", "n")),
                   *((x, pa.binary()) for x in ("v", "ids", "keys", "m", "links"))])


class Graph:
    """Navigable small-world graph of normalised vectors. Nodes are ordered by
    falling level, so level ``l`` holds the first ``sizes[l]`` of them."""

    def __init__(self, vectors: np.ndarray, keys: np.ndarray | None = None, links: list[np.ndarray] | None = None):
        self.v = np.ascontiguousarray(vectors, np.float32)
        if links is not None:
            self.links = links
            return
        self.links = []
        u = (mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
        level = np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(UPPER_LINKS)).astype(int)
        self.order = np.argsort(-level, kind="stable")
        self.v = self.v[self.order]
        sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
        self.links = [np.zeros((0, 0), np.int32)] * len(sizes)
        for k in range(len(sizes) - 1, -1, -1):
            self.links[k] = self._level(k, sizes[k], GROUND_LINKS if k == 0 else UPPER_LINKS)

    # -- building

    def _level(self, k: int, size: int, width: int) -> np.ndarray:
        links = np.full((size, width), -1, np.int32)
        self.links[k] = links
        used = np.zeros(size, np.int32)
        done = min(size, 64)
        self._connect(links, used, np.arange(done), *self._nearest(np.arange(done), np.arange(done), min(width, done)))
        while done < size:
            batch = np.arange(done, min(size, done + max(64, min(512, done // 4))))
            entry = self._descend(self.v[batch], k + 1)
            ids, sims = self._beam(self.v[batch], k, entry, max(BUILD_BEAM, width), limit=done)
            near, near_sims = self._nearest(batch, batch, min(width, len(batch)))
            ids, sims = np.concatenate([ids, near], 1), np.concatenate([sims, near_sims], 1)
            self._connect(links, used, batch, ids, sims)
            done = int(batch[-1]) + 1
        return self._returned(links) if k == 0 else links

    def _returned(self, links: np.ndarray) -> np.ndarray:
        """Links that were not returned, or overwritten, are returned in further
        columns, the nearest first: else nodes that few others link to are missed."""
        n, width = links.shape
        to, back, sims = [], [], []
        for at in _slices(np.arange(n), SLICE_VALUES, width * self.v.shape[1]):
            own = links[at]
            near = np.maximum(own, 0)
            i, j = np.nonzero((own >= 0) & ~(links[near] == at[:, None, None]).any(axis=2))
            to.append(own[i, j])
            back.append(at[i].astype(np.int32))
            sims.append(np.einsum("kd,kd->k", self.v[own[i, j]], self.v[at[i]]))
        to, back, sims = (np.concatenate(x) if x else links.reshape(-1)[:0] for x in (to, back, sims))
        by = np.lexsort((-sims, to))
        to, back = to[by], back[by]
        nth = np.arange(len(to)) - np.searchsorted(to, to)
        free = nth < RETURNED_LINKS
        more = np.full((n, RETURNED_LINKS), -1, np.int32)
        more[to[free], nth[free]] = back[free]
        return np.concatenate([links, more], axis=1)

    def _nearest(self, rows: np.ndarray, among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        s = self.v[rows] @ self.v[among].T
        s[rows[:, None] == among[None, :]] = -2
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        got = np.take_along_axis(s, top, 1)
        return np.where(got > -2, among[top], -1), got

    def _connect(self, links: np.ndarray, used: np.ndarray, rows: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Links of new nodes: near but diverse candidates, and links back."""
        width = links.shape[1]
        order = np.argsort(-np.where(ids >= 0, sims, -2), axis=1)
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        c = ids.shape[1]
        vec = self.v[np.maximum(ids, 0)]
        between = np.einsum("qid,qjd->qij", vec, vec)
        chosen = np.zeros(ids.shape, bool)
        for j in range(c):  # a candidate nearer to a chosen one than to the node is left out
            close = np.where(chosen, between[:, j, :], -2).max(axis=1)
            chosen[:, j] = (ids[:, j] >= 0) & (sims[:, j] > close) & (chosen.sum(axis=1) < width // 2)
        rest = (ids >= 0) & ~chosen
        rank = np.where(chosen, 0, np.where(rest, 1, 2))
        pick = np.argsort(rank, axis=1, kind="stable")[:, :width]
        own = np.where(np.take_along_axis(rank, pick, 1) < 2, np.take_along_axis(ids, pick, 1), -1)
        links[rows, : own.shape[1]] = own
        used[rows] = (own >= 0).sum(axis=1)
        # links back: into free slots, else over a random later slot; early links stay as long-range ones
        to, back = own.ravel(), np.repeat(rows, own.shape[1])
        ok = to >= 0
        to, back = to[ok], back[ok]
        by = np.argsort(to, kind="stable")
        to, back = to[by], back[by]
        first = np.concatenate([[True], to[1:] != to[:-1]]) if len(to) else np.zeros(0, bool)
        nth = np.arange(len(to)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(to) else to
        slot = used[to] + nth
        over = slot >= width
        half = width // 2
        slot[over] = half + (mix((back[over] * 2654435761 + to[over]).astype(np.uint64)) % np.uint64(width - half)).astype(np.int64)
        new = ~(links[to] == back[:, None]).any(axis=1)
        links[to[new], slot[new]] = back[new]
        used[:] = (links >= 0).sum(axis=1)

    # -- searching

    def _descend(self, q: np.ndarray, down_to: int) -> np.ndarray:
        entry = np.zeros(len(q), np.int64)
        for k in range(len(self.links) - 1, down_to - 1, -1):
            best = np.einsum("qd,qd->q", self.v[entry], q)
            live = np.arange(len(q))
            while len(live):
                near = self.links[k][entry[live]]
                s = np.einsum("qmd,qd->qm", self.v[np.maximum(near, 0)], q[live])
                s[near < 0] = -2
                j = s.argmax(axis=1)
                top = s[np.arange(len(live)), j]
                better = top > best[live]
                live, j, top, near = live[better], j[better], top[better], near[better]
                entry[live], best[live] = near[np.arange(len(live)), j], top
        return entry

    def _beam(self, q: np.ndarray, k: int, entry: np.ndarray, width: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best nodes found for each query and their similarities.
        A step follows the links of the best few that were not followed yet."""
        links, n = self.links[k], len(self.links[k]) if limit is None else limit
        width = min(width, n)
        expand = min(max(2, width // 12), width)
        out = np.empty((len(q), width), np.int64), np.empty((len(q), width), np.float32)
        for block in _slices(np.arange(len(q)), VISITED, n):
            m = len(block)
            row = np.arange(m)  # the block's queries that go on
            seen = np.zeros(m * n, bool)
            ids = np.full((m, width), -1, np.int32)
            far = np.full((m, width), 2, np.float32)  # the negative similarity
            fresh = np.zeros((m, width), bool)
            start = np.minimum(entry[block], n - 1)
            ids[:, 0], far[:, 0], fresh[:, 0] = start, -np.einsum("qd,qd->q", self.v[start], q[block]), True
            seen[row * n + start] = True
            while True:
                rank = np.where(fresh, far, 3)
                top = np.argpartition(rank, expand - 1, axis=1)[:, :expand] + np.arange(len(row))[:, None] * width
                ok = rank.take(top) < 3
                some = ok.any(axis=1)
                if not some.all():
                    over = block[row[~some]]
                    out[0][over], out[1][over] = ids[~some], -far[~some]
                    row, ids, far, fresh, ok = row[some], ids[some], far[some], fresh[some], ok[some]
                    if not len(row):
                        break
                    top = top[some] % width + np.arange(len(row))[:, None] * width
                near = links[np.where(ok, ids.take(top), 0)]
                fresh.reshape(-1)[top] = False
                near[~ok] = -1
                near = near.reshape(len(row), -1)
                near[near >= n] = -1
                near.sort(axis=1)
                new = near >= 0
                new[:, 1:] &= near[:, 1:] != near[:, :-1]
                new &= ~seen.take(np.maximum(near, 0) + (row * n)[:, None])
                at = np.flatnonzero(new)
                of, node = row[at // near.shape[1]], near.take(at)
                seen[of * n + node] = True
                away = np.full(near.shape, 2, np.float32)
                away.reshape(-1)[at] = -np.einsum("kd,kd->k", self.v[node], q[block[of]])
                far, ids, fresh = np.concatenate([far, away], 1), np.concatenate([ids, near], 1), np.concatenate([fresh, new], 1)
                best = np.argpartition(far, width - 1, axis=1)[:, :width] + np.arange(len(row))[:, None] * far.shape[1]
                far, ids, fresh = far.take(best), ids.take(best), fresh.take(best)
        return out

    def links_of(self, q: np.ndarray, threshold: float, beam: int = SEARCH_BEAM, audit: int = AUDIT,
                 recall: float = RECALL) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) of cosine about ``threshold`` or more, for exact checking."""
        return _joined(self.pairs(q, threshold, self.audited_beam(threshold, beam, recall), audit, recall))

    def audited_beam(self, threshold: float, beam: int = SEARCH_BEAM, recall: float = RECALL) -> int:
        """The beam, doubled until it finds the probes' nodes."""
        if not len(self.v):
            return beam
        probe, home = self._probes(threshold)
        while beam * 2 < len(self.v):
            rows, nodes = _joined(self._widened(probe, np.float32(threshold - 1e-4), beam))
            if (home[rows] == nodes).sum() >= recall * len(home):
                break
            beam *= 2
        return beam

    def pairs(self, q: np.ndarray, threshold: float, beam: int, audit: int = AUDIT,
              recall: float = RECALL) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of ``links_of`` in parts of bounded size, by a beam that is
        doubled until it finds the links of ``audit`` of the queries."""
        low = np.float32(threshold - 1e-4)
        if not len(self.v) or not len(q):
            return
        sample = np.unique(np.linspace(0, len(q) - 1, min(audit, len(q))).astype(int))
        truth = np.empty((len(sample), len(self.v)), bool)
        for at in _slices(np.arange(len(self.v)), VISITED // 4, len(sample)):
            truth[:, at] = q[sample] @ self.v[at].T >= low
        while beam * 2 < len(self.v):
            if sum(truth[rows, nodes].sum() for rows, nodes in self._widened(q[sample], low, beam)) >= recall * truth.sum():
                break
            beam *= 2
        yield from self._widened(q, low, beam)

    def _probes(self, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Vectors whose cosine with a node is the threshold, and these nodes; every
        other one is turned towards another node, the rest anywhere."""
        home = np.unique(np.linspace(0, len(self.v) - 1, min(PROBES, len(self.v))).astype(int))
        rng = np.random.default_rng(len(self.v))
        v = self.v[home].astype(np.float64)
        away = rng.normal(size=v.shape)
        away[::2] = self.v[rng.integers(0, len(self.v), len(away[::2]))]
        away -= (away * v).sum(axis=1, keepdims=True) * v
        size = np.sqrt((away * away).sum(axis=1, keepdims=True))
        some = size > 1e-6
        away = np.where(some, away / np.where(some, size, 1.0), 0.0)
        probe = np.where(some, threshold * v + np.sqrt(max(1.0 - threshold * threshold, 0.0)) * away, v)
        return probe.astype(np.float32), home

    def _widened(self, q: np.ndarray, low: np.float32, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Beam searches; queries whose beam is mostly links search again with a
        wider one, in the end by scanning the shard."""
        live = np.arange(len(q))
        entry = self._descend(q, 1)
        while len(live):
            scan = width * 2 >= len(self.v)
            full = []
            for part in _slices(live, VISITED // 4, len(self.v) if scan else width):
                if scan:
                    a, b = np.nonzero(q[part] @ self.v.T >= low)
                    yield part[a], b
                    continue
                ids, sims = self._beam(q[part], 0, entry[part], width)
                hit = sims >= low
                over = hit.sum(axis=1) * 2 > width
                a, b = np.nonzero(hit & ~over[:, None])
                yield part[a], ids[a, b]
                full.append(part[over])
            live = np.concatenate(full) if full else live[:0]
            width *= 4


def _slices(rows: np.ndarray, entries: int, width: int) -> Iterator[np.ndarray]:
    """The rows in parts of ``entries`` at most, where a row has ``width`` of them."""
    step = max(1, entries // max(width, 1))
    return (rows[i: i + step] for i in range(0, len(rows), step))


def _joined(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    rows, nodes = zip((none, none), *pairs)
    return np.concatenate(rows), np.concatenate(nodes)


def spanning_stars(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) that connect what the pairs (a, b) connect."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    members = np.flatnonzero(label != np.arange(size))
    return members, label[members]


class Forest:
    """Which nodes are connected, from pairs in any number: kept as stars when
    there are more of them than nodes."""

    def __init__(self, size: int):
        self.size, self.pairs, self.held = size, [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = a != b
        self.pairs.append((a[apart], b[apart]))
        self.held += int(apart.sum())
        if self.held > 2 * self.size:
            self.stars()

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        self.pairs = [spanning_stars(*_joined(iter(self.pairs)), self.size)]
        self.held = len(self.pairs[0][0])
        return self.pairs[0]


class Vectors:
    """Vectors as given, and what normalises them in double precision."""

    def __init__(self, raw: np.ndarray):
        self.raw, self.scale, self.size = raw, np.ones((len(raw), 1)), np.ones((len(raw), 1))
        self.slices = list(_slices(np.arange(len(raw)), SLICE_VALUES, raw.shape[1]))
        for at in self.slices:
            exact = raw[at].astype(np.float64)
            self.scale[at] = np.abs(exact).max(axis=1, keepdims=True)
            exact /= self.scale[at]
            self.size[at] = np.sqrt((exact * exact).sum(axis=1, keepdims=True))

    def unit(self, at: np.ndarray) -> np.ndarray:
        return self.raw[at].astype(np.float64) / self.scale[at] / self.size[at]

    def single(self) -> np.ndarray:
        out = np.empty(self.raw.shape, np.float32)
        for at in self.slices:
            out[at] = self.unit(at)
        return out


class Asked:
    """A shard that is asked: its graph, and the links found so far."""

    def __init__(self, rows: list[dict], threshold: float, beam: int):
        ids, m, v = (np.concatenate([r[name] for r in rows if r["level"] == 0]) for name in ("ids", "m", "v"))
        links = [np.concatenate([r["links"] for r in rows if r["level"] == k]) for k in sorted({r["level"] for r in rows})]
        rows.clear()  # they hold their batches
        self.ids, self.m, self.of = ids, m, Vectors(v)
        self.graph = Graph(self.of.single(), links=links)
        self.threshold, self.beam = threshold, self.graph.audited_beam(threshold, beam)
        self.forest = Forest(len(self.ids))

    def links(self, q: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the rows it links with and one of its links; ``place``
        is a query's own node here, or -1."""
        ask = Vectors(q)
        n, anchor = np.zeros(len(q), np.int64), np.full(len(q), -1)
        for rows, nodes in self.graph.pairs(ask.single(), self.threshold, self.beam):
            good = np.zeros(len(rows), bool)
            for at in _slices(np.arange(len(rows)), SLICE_VALUES, q.shape[1]):  # cosine in double precision
                good[at] = np.einsum("kd,kd->k", ask.unit(rows[at]), self.of.unit(nodes[at])) >= self.threshold
            good &= place[rows] != nodes
            rows, nodes = rows[good], nodes[good]
            np.add.at(n, rows, self.m[nodes])
            new = anchor[rows] < 0
            anchor[rows[new]] = nodes[new]
            self.forest.add(anchor[rows], nodes)
        return n, anchor


def build_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The graphs of the shards in these rows ``(shard, k, id, m, v)``, one for each
    vector length, as blocks of nodes; level 0 has their vectors as well."""
    shard, key, ids, m, long, flat = [], [], [], [], [], []
    for batch in batches:
        col = dict(zip(batch.schema.names, batch.columns))
        key += [int(x[:15], 16) for x in col["k"].to_pylist()]
        for to, x in ((shard, col["shard"]), (ids, col["id"]), (m, col["m"]), (long, pc.list_value_length(col["v"])), (flat, col["v"].flatten())):
            to.append(x.to_numpy(zero_copy_only=False).copy())
    if not key:
        return
    key = np.array(key, np.int64)
    shard, ids, m, long, flat = (np.concatenate(x) for x in (shard, ids, m, long, flat))
    start = np.cumsum(long) - long
    for s, d in sorted({*zip(shard.tolist(), long.tolist())}):
        at = np.flatnonzero((shard == s) & (long == d))
        raw = flat.reshape(-1, d) if len(at) == len(long) else flat[start[at][:, None] + np.arange(d)]
        g = Graph(Vectors(raw).single(), key[at])
        step = max(1, BLOCK_BYTES // (d * raw.itemsize))
        for level, links in enumerate(g.links):
            for block, i in enumerate(range(0, len(links), step)):
                rows = g.order[i: min(i + step, len(links))]
                here = at[rows]
                own = [x.tobytes() if level == 0 else None for x in (raw[rows], ids[here], key[here], m[here])]
                one = [s, d, level, block, i, len(rows), *own, links[i: i + step].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, BLOCK.types)], schema=BLOCK)


def searcher(kind: str, threshold: float, beam: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of a task's rows: a shard's blocks, then the blocks that ask it,
    for each vector length."""
    value = np.float32 if kind == "float" else np.float64
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def answers(asked: Asked, asks: list[dict]) -> pa.RecordBatch:
        q, ids, keys, place = (np.concatenate([x[name] for x in asks]) for name in ("v", "ids", "keys", "place"))
        n, anchor = asked.links(q, place)
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[some], keys[some], n[some], asked.ids[anchor[some]])], schema=schema)

    def rest(asked: Asked) -> pa.RecordBatch:
        member, root = asked.forest.stars()
        return pa.RecordBatch.from_arrays([pa.array(asked.ids[member]), pa.nulls(len(member), pa.int64()), pa.array(np.zeros(len(member), np.int64)),
                                           pa.array(asked.ids[root])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, asks, asked = None, [], [], None
        for batch in batches:
            pa.default_memory_pool().release_unused()
            for row in _blocks(batch, value):
                if now != (row["task"], row["dim"]):
                    if asked:
                        yield from [answers(asked, asks)] if asks else []
                        yield rest(asked)
                    now, blocks, asks, asked = (row["task"], row["dim"]), [], [], None
                if not row["asks"]:
                    blocks.append(row)
                    continue
                if blocks:
                    asked, blocks = Asked(blocks, threshold, beam), []  # takes the blocks out of the list
                if asked:
                    asks.append(row)
                    if sum(len(x["ids"]) for x in asks) >= ASK_ROWS:
                        yield answers(asked, asks)
                        asks = []
        if asked:
            yield from [answers(asked, asks)] if asks else []
            yield rest(asked)

    return run


def _blocks(batch: pa.RecordBatch, value: type) -> Iterator[dict]:
    """Rows of a batch, with arrays (views of the batch) instead of bytes."""
    if not batch.num_rows:
        return
    kinds = {"v": value, "ids": np.int64, "keys": np.int64, "m": np.int64, "links": np.int32}
    col = dict(zip(batch.schema.names, batch.columns))
    plain = {name: x.to_pylist() for name, x in col.items() if name not in kinds}
    there, at, data = {}, {}, {}
    for name in kinds:  # a scalar would be a copy
        x = col[name]
        there[name] = x.is_valid().to_pylist()
        _, offsets, data[name] = x.buffers()
        at[name] = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(x.type) else np.int32)[x.offset: x.offset + len(x) + 1].tolist()
    for i in range(batch.num_rows):
        row = {name: x[i] for name, x in plain.items()}
        for name, kind in kinds.items():
            a, b = at[name][i], at[name][i + 1]
            row[name] = np.frombuffer(data[name], kind, (b - a) // np.dtype(kind).itemsize, a) if there[name][i] else None
        if row["v"] is not None:
            row["v"] = row["v"].reshape(row["n"], row["dim"])
        if row["links"] is not None:
            row["links"] = row["links"].reshape(row["n"], -1)
        row["place"] = np.arange(row["start"], row["start"] + row["n"]) if row["same"] else np.full(row["n"], -1)
        yield row


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95,
                    shards: int | None = None, beam: int = SEARCH_BEAM) -> DataFrame:
    """``id, n_links, component_id, kept`` of every row."""
    spark = vectors.sparkSession
    tidy_shuffles(spark)
    v = F.col("__v")
    kind = "float" if vectors.select(vec_col).dtypes[0][1] == "array<float>" else "double"
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("__v"))
    fine = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
                      & F.exists(v, lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are the same component
    src = src.withColumn("__v", F.when(fine, F.transform(v, lambda x: (x + F.lit(0.0)).cast(kind))))
    text = F.to_json(F.struct(v.cast("array<double>").alias("__v")))
    rows = stage_table(src.withColumn("k", F.when(v.isNotNull(), F.sha2(text, 256))), "vec-rows")
    # vectors whose rows all lack an id are numbered after the largest id
    known = rows.agg(F.max("id").alias("top"), F.count_if(F.col("id").isNull() & F.col("k").isNotNull()).alias("open")).first()
    after = (known["top"] if known["top"] is not None else -1) + 1
    if known["open"] and after > 2**63 - 2**54:
        raise ValueError("no numbers are left above the ids for rows without id")
    wide = (rows.where("k is not null").groupBy("k").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.first("__v").alias("v")))
    if known["open"]:
        wide = wide.withColumn("id", F.coalesce("id", F.lit(after) + F.monotonically_increasing_id()))
    wide = stage_table(wide, "vec-nodes")
    # from here on only the graphs hold vectors
    src = stage_table(rows.select("id", "k"), "vec-row-names")
    discard(rows)
    nodes = stage_table(wide.select("k", "id", "m"), "vec-node-names")
    size = wide.agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("values")).first()
    shards = shards or max(MIN_SHARDS, -(-size["n"] // SHARD_ROWS), -(-(size["values"] or 0) // SHARD_VALUES))
    own = wide.withColumn("shard", F.pmod(F.xxhash64("k"), F.lit(shards).cast("long")).cast("int"))
    graphs = stage_table(own.repartitionById(shards, "shard").sortWithinPartitions("shard", "k").mapInArrow(
        build_blocks, "shard int, dim int, level int, block int, start int, n int, v binary, ids binary, keys binary, m binary, links binary"), "vec-graphs")
    discard(wide)

    # a turn asks the shards from first to last; each is asked by `split` tasks
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    turn = min(shards, max(1, TURN_ROWS // max(size["n"], 1)))
    split = min(shards, -(-parts // turn))
    found = []
    for first in range(0, shards, turn):
        last = min(shards, first + turn) - 1
        each = lambda top: F.explode(F.sequence(F.lit(0), F.lit(top)))
        asked = (graphs.where(F.col("shard").between(first, last)).withColumn("slice", each(split - 1))
                 .select(((F.col("shard") - first) * split + F.col("slice")).alias("task"), F.lit(False).alias("asks"), F.lit(False).alias("same"), *graphs.columns))
        asking = (graphs.where("level = 0").withColumn("links", F.lit(None).cast("binary")).withColumn("m", F.lit(None).cast("binary"))
                  .withColumn("other", each(last - first))
                  .select((F.col("other") * split + (F.col("shard") + F.col("block")) % split).alias("task"), F.lit(True).alias("asks"),
                          (F.col("shard") == F.col("other") + first).alias("same"), *graphs.columns))
        dealt = asked.unionByName(asking).repartitionById((last - first + 1) * split, "task")
        found.append(stage_table(dealt.sortWithinPartitions("task", "dim", "asks", "level", "shard", "block").mapInArrow(
            searcher(kind, threshold, beam), "id long, key long, links long, root long"), "vec-links"))
    found = spark.read.parquet(*[x._staged_path for x in found])
    roots = components(found.where("root is not null").select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.where("key is not null").groupBy("key").agg(F.sum("links").alias("links"))
    key = F.conv(F.substring("k", 1, 15), 16, 10).cast("long")
    node = nodes.select(F.col("k").alias("nk"), "m", F.col("id").alias("low"), key.alias("nkey"))
    node = node.join(links, node["nkey"] == links["key"], "left").join(roots, F.col("low") == F.col("node"), "left")
    node = stage_table(node.select("nk", "low", F.coalesce("root", "low").alias("component"),
                                   (F.coalesce("links", F.lit(0)) + F.col("m") - 1).cast("long").alias("links")), "vec-nodes-out")
    out = src.join(node, F.col("k") == F.col("nk"), "left")
    component = F.coalesce("component", "id")
    named = F.when(component < after, component)
    unnamed = F.when(F.col("id").isNull(), F.coalesce((component >= after) & (component == F.col("low")), component.isNull()))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      named.alias("component_id"), F.coalesce(unnamed, F.col("id") == component).alias("kept"))
