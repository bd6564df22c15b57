"""Embedding near-duplicates against all pairs."""

import math

import numpy as np

from labelscope.llm import hnsw as H


def plain(rows, t=0.95):
    def usable(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    ok = [usable(v) for _, v in rows]
    unit = [np.array(v) / np.linalg.norm(v) if o else None for (_, v), o in zip(rows, ok)]
    link = [[i != j and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= t
             for j in range(len(rows))] for i in range(len(rows))]
    root = {}
    for i, _ in rows:
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(len(rows)):
            if link[i][j]:
                a, b = find(rows[i][0]), find(rows[j][0])
                root[max(a, b)] = min(a, b)
    return sorted((rows[i][0], sum(link[i]), find(rows[i][0])) for i in range(len(rows)))


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in H.near_duplicates(df, **kw).collect())


def test_clusters_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(150, 16)))]
    for c in range(6):
        centre = rng.normal(size=16)
        for k in range(4 + 12 * c):
            rows.append((1000 + 100 * c + k, (centre + rng.normal(size=16) * 0.13).tolist()))
    assert run(spark, rows, shards=3, beam=8) == plain(rows)


def test_unusable_vectors_copies_and_lengths(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [float("nan"), 1.0, 0.0]),
            (6, [float("inf"), 1.0, 0.0]), (9, v), (7, v), (8, [2.0, 0.0, 0.0]), (10, [1.0, 0.0]), (11, w), (12, [-0.0, 1.0, 0.0]),
            (13, [1e200, 0.0, 0.0])]
    got = run(spark, rows)
    expect = {i: (0, i) for i, _ in rows} | {9: (3, 7), 7: (3, 7), 8: (3, 7), 13: (3, 7), 11: (1, 11), 12: (1, 11)}
    assert got == sorted((i, *x) for i, x in expect.items())


def test_empty_table(spark):
    assert run(spark, []) == []


def test_graph_search_recall():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 24))
    v[:400] = v[0] + rng.normal(size=(400, 24)) * 0.08
    v /= np.linalg.norm(v, axis=1)[:, None]
    g = H.Graph(v, np.arange(len(v)))
    rows, nodes = g.links_of(v.astype(np.float32), 0.95)
    truth = (v @ v.T) >= 0.9501
    found = np.zeros_like(truth)
    found[rows, g.order[nodes]] = True
    assert (found & truth).sum() >= 0.999 * truth.sum()


def test_spanning_stars_connect_the_same():
    a, b = np.array([0, 1, 5, 6]), np.array([1, 2, 6, 7])
    member, root = H.spanning_stars(a, b, 9)
    assert dict(zip(member.tolist(), root.tolist())) == {1: 0, 2: 0, 6: 5, 7: 5}


def sparse(seed, n, dim, planted):
    """Vectors that link with nothing, and a copy near the threshold of every few of them."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1)[:, None]
    of = np.linspace(0, n - 1, planted).astype(int)
    side = rng.normal(size=(planted, dim))
    side -= (side * v[of]).sum(axis=1, keepdims=True) * v[of]
    side /= np.linalg.norm(side, axis=1)[:, None]
    cos = rng.uniform(0.951, 0.97, (planted, 1))
    return np.concatenate([v, cos * v[of] + np.sqrt(1 - cos * cos) * side])


def test_sparse_links_equal_all_pairs(spark):
    v = sparse(11, 6000, 64, 120)
    truth = (v @ v.T) >= 0.95
    np.fill_diagonal(truth, False)
    got = run(spark, [(i, x.tolist()) for i, x in enumerate(v)], shards=2, beam=3)
    links = {i: n for i, n, _ in got}
    assert truth.sum() == 240
    assert sum(links.values()) >= 0.99 * truth.sum() and all(links[i] <= n for i, n in enumerate(truth.sum(axis=1)))


def test_audit_without_links_widens_the_beam():
    v = sparse(12, 6000, 64, 0)
    g = H.Graph(v, np.arange(len(v)))
    q = sparse(12, 6000, 64, 600)[6000:].astype(np.float32)
    rows, nodes = g.links_of(np.concatenate([sparse(13, 600, 64, 0).astype(np.float32), q]), 0.95, beam=3, audit=1)
    of = np.linspace(0, 5999, 600).astype(int)
    found = set(zip(rows.tolist(), g.order[nodes].tolist()))
    assert sum((600 + i, int(x)) in found for i, x in enumerate(of)) >= 0.99 * 600


def test_rows_without_id(spark):
    v, w, u = [1.0, 0.0, 0.0], [0.99, 0.1, 0.0], [0.0, 0.0, 1.0]
    big = 2**60
    rows = [(big + 1, v), (big + 3, w), (None, [0.0, 1.0, 0.0]), (None, v), (None, u), (None, u), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in H.near_duplicates(df, shards=1).collect()), key=str)
    assert got == sorted([(big + 1, 2, big + 1, True), (big + 3, 2, big + 1, False), (None, 2, big + 1, False), (None, 0, None, True),
                          (None, 1, None, True), (None, 1, None, True), (None, 0, None, True)], key=str)
    alone = spark.createDataFrame([(None, v), (None, w)], "vec_id long, embedding array<double>")
    assert sorted((r["n_links"], r["component_id"], r["kept"]) for r in H.near_duplicates(alone).collect()) == [(1, None, False), (1, None, True)]


def test_staged_graphs_are_small_blocks(spark, monkeypatch):
    staged = {}

    def stage(df, name="stage", put=H.stage_table):
        staged[name] = put(df, name)
        return staged[name]

    monkeypatch.setattr(H, "stage_table", stage)
    v = sparse(14, 3000, 64, 0)
    run(spark, [(i, x.tolist()) for i, x in enumerate(v)], shards=2)
    graphs = staged["vec-graphs"]
    kinds = [name for name, kind in graphs.dtypes if kind == "binary"]
    most = graphs.selectExpr(*(f"max(length({name})) as {name}" for name in kinds)).first()
    assert max(x for x in most if x is not None) <= 1 << 17


def test_most_links_are_returned():
    v = sparse(15, 3000, 24, 0)
    links = H.Graph(v, np.arange(len(v))).links[0]
    a, j = np.nonzero(links >= 0)
    b = links[a, j]
    assert (links[b] == a[:, None]).any(axis=1).mean() >= 0.8


def test_forest_holds_no_more_than_its_nodes():
    rng = np.random.default_rng(16)
    forest = H.Forest(100)
    for _ in range(50):
        a = rng.integers(0, 50, 1000)
        forest.add(a, a + 50 * (rng.random(1000) < 0.5))
        assert sum(len(x) for x, _ in forest.pairs) <= 200
    member, root = forest.stars()
    assert sorted(zip(member.tolist(), root.tolist())) == [(i + 50, i) for i in range(50)]


def test_streamed_blocks_equal_all_pairs(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(H, "BLOCK_BYTES", 4096)
    monkeypatch.setattr(H, "ASK_ROWS", 70)
    v = sparse(17, 600, 16, 90)
    v[:40] = v[0] + v[:40] * 0.05
    ids, shard = np.arange(len(v)) * 3 + 1, np.arange(len(v)) % 2
    rows = pa.RecordBatch.from_pylist([{"shard": int(s), "k": f"{int(i):064x}"[::-1], "id": int(i), "m": 1, "v": x.tolist()} for s, i, x in zip(shard, ids, v)],
                                      schema=pa.schema([("shard", pa.int32()), ("k", pa.string()), ("id", pa.int64()), ("m", pa.int64()), ("v", pa.list_(pa.float64()))]))
    blocks = [x for b in H.build_blocks(iter([rows])) for x in b.to_pylist()]
    assert len(blocks) > 10
    links, edges = {}, []
    for s in (0, 1):
        asks = [x | {"task": s, "asks": False, "same": False} for x in blocks if x["shard"] == s]
        asks += [x | {"task": s, "asks": True, "same": x["shard"] == s, "m": None, "links": None} for x in blocks if x["level"] == 0]
        schema = pa.schema([("task", pa.int32()), ("asks", pa.bool_()), ("same", pa.bool_()), *H.BLOCK])
        batches = [pa.RecordBatch.from_pylist(asks[i: i + 7], schema=schema) for i in range(0, len(asks), 7)]
        for got in H.searcher("double", 0.95, 24)(iter(batches)):
            for row in got.to_pylist():
                edges.append((row["id"], row["root"]))
                if row["key"] is not None:
                    links[row["id"]] = links.get(row["id"], 0) + row["links"]
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    truth = unit @ unit.T >= 0.95
    np.fill_diagonal(truth, False)
    assert [links.get(int(i), 0) for i in ids] == truth.sum(axis=1).tolist()
    a, b = np.nonzero(truth)
    at = {int(i): n for n, i in enumerate(ids)}
    mine = H.spanning_stars(np.array([at[x] for x, _ in edges]), np.array([at[y] for _, y in edges]), len(v))
    assert [x.tolist() for x in mine] == [x.tolist() for x in H.spanning_stars(a, b, len(v))]
