"""Forest search against all pairs."""

import math

import numpy as np

from labelscope.llm import rp_forest as R


def plain(rows, k=20, every=20):
    usable = [(i, np.array(v, float)) for i, v in rows
              if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    dim = max((len(v) for _, v in usable), default=0)
    seen, out = set(), []
    distinct = []
    for i, v in usable:
        if (i, v.tobytes()) not in seen:
            seen.add((i, v.tobytes()))
            distinct.append((i, np.concatenate([v, np.zeros(dim - len(v))])))
    for n, (i, v) in enumerate(distinct):
        if i % every == 0:
            near = sorted((-float((v * w).sum()), j) for m, (j, w) in enumerate(distinct) if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return sorted(out)


def run(spark, rows, kind="double", **kw):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    got = R.nearest(df, df.where("vec_id % 20 = 0"), **kw)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


def same(got, expect):
    assert [x[:3] for x in got] == [x[:3] for x in expect]
    assert np.allclose([x[3] for x in got], [x[3] for x in expect], rtol=1e-12, atol=1e-12)


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(1)
    scale = rng.uniform(0.1, 5, 600)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 12)) * scale)]
    same(run(spark, rows, leaf_rows=16, bin_rows=50), plain(rows))


def test_copies_ties_and_unusable_vectors(spark):
    v, w = [1.0, 2.0, 0.0], [2.0, 1.0, 0.0]
    rows = [(i, v) for i in range(100)] + [(100 + i, w) for i in range(70)]
    rows += [(200, None), (220, []), (240, [0.0, 0.0, 0.0]), (260, [1.0, None, 0.0]), (280, [float("nan"), 1.0, 0.0]),
             (300, [float("inf"), 1.0, 0.0]), (None, v), (320, [1.0]), (340, [-0.0, 1.0, 0.0]), (340, [0.0, 1.0, 0.0]), (360, [5.0, 5.0]),
             (380, v), (380, v), (400, v), (400, w)]
    expect = plain([(i, [x + 0.0 if x is not None else None for x in u] if u else u) for i, u in rows])
    same(run(spark, rows), expect)


def test_fewer_candidates_than_k_one_row_and_empty_table(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (20, [-1.0, 1.0])]
    same(run(spark, rows), plain(rows))
    assert run(spark, [(0, [1.0, 0.0])]) == [] and run(spark, []) == []


def test_extreme_lengths_do_not_crash(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e200, 1e200]), (20, [1e-200, 1e-200]), (3, [-1e200, 1.0])]
    got = run(spark, rows)
    assert {x[0] for x in got} == {0, 20} and len(got) == 6


def test_recall_by_audit(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 24)) * 2
    v = centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 24))
    v *= rng.uniform(0.5, 2, (6000, 1))
    rows = [(i, x.tolist()) for i, x in enumerate(v.astype(np.float32))]
    got = run(spark, rows, kind="float", leaf_rows=64, bin_rows=1000, least_budget=500)
    expect = plain([(i, [float(np.float32(x)) for x in u]) for i, u in rows])
    truth = {(q, i) for q, _, i, _ in expect}
    assert len(got) == len(expect)
    assert len(truth & {(q, i) for q, _, i, _ in got}) >= 0.93 * len(truth)
    exact = {(q, i): s for q, _, i, s in expect}
    assert all(abs(s - exact[q, i]) < 1e-9 for q, _, i, s in got if (q, i) in exact)


def test_queue_takes_leaves_by_smallest_margin():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 6))
    forest = R.Forest(8, 6, float(np.abs(x).max()), 10.0, 8)
    placed = forest.place(x)
    trees = [R._fit_tree(placed, 8, s) for s in range(3)]
    forest.normal, forest.cut = np.stack([t[0] for t in trees]), np.stack([t[1] for t in trees])
    leaf = forest.leaf_of(placed)
    counts = np.stack([np.bincount(leaf[:, t], minlength=8) for t in range(3)])
    assert counts.min() >= 50  # medians keep the leaves even
    forest.set_counts(counts, 130)
    assert forest.n_bins == 12 and forest.bins.max() == 11
    q = forest.aim(x[:5])
    for i, taken in enumerate(forest.order(q, np.inf)):
        assert len(taken) == 24 and taken[-1][2] == 1500
        pri = []
        for t, x_leaf, _ in taken:
            at, p = x_leaf + 8, np.inf
            while at > 1:
                m = float(forest.normal[t][at // 2] @ q[i] - forest.cut[t][at // 2])
                p, at = min(p, m if at % 2 else -m), at // 2
            pri.append(p)
        assert all(a >= b - 1e-5 for a, b in zip(pri, pri[1:]))


def test_long_leaves_spread_over_bins():
    forest = R.Forest(8, 2, 1.0, 1.0, 2)
    forest.set_counts(np.array([[5, 250], [100, 3]]), 100)
    assert forest.bins.tolist() == [[0, 1], [4, 5]] and forest.spread.tolist() == [[1, 3], [1, 1]] and forest.n_bins == 6
