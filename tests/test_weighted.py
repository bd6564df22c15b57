"""General weighted sampling (R5) against plain computations."""

import hashlib
import math
from bisect import bisect_right
from itertools import accumulate

import pytest

from labelscope.operators import weighted as W


def md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def plain_draws(rows, n, seed=42):
    top = max(w for _, w in rows)
    parts = {i: max(math.floor(w / top * 2**W.PART_BITS + 0.5), 1) for i, w in rows if w > 0}
    order = sorted(parts, key=lambda i: (md5(seed, "row", i), i))
    ends = list(accumulate(parts[i] for i in order))
    out = []
    for d in range(n):
        h = md5(seed, "place", d)
        out.append((d, order[bisect_right(ends, (int(h[:15], 16) * 2**60 + int(h[15:30], 16)) % ends[-1])]))
    return out


def draws(spark, rows, n, **kw):
    df = spark.createDataFrame(rows, "id long, w double").repartition(3)
    return sorted(tuple(r) for r in W.weighted_draws(df, "w", n, columns=["id"], **kw).collect())


WEIGHTS = {
    "even": lambda i: 1.0,
    "zeros": lambda i: float(i % 3),
    "one takes nearly all": lambda i: 1e12 if i == 7 else 1.0,
    "far apart": lambda i: 10.0 ** (i % 30 - 15),
    "tiny": lambda i: 5e-324 * (1 + i % 2),
}


@pytest.mark.parametrize("kind", sorted(WEIGHTS))
def test_draws_equal_a_plain_line(spark, kind):
    rows = [(i, WEIGHTS[kind](i)) for i in range(500)]
    assert draws(spark, rows, 800) == plain_draws(rows, 800)


def test_hot_row_is_spread_over_cells(spark, monkeypatch):
    monkeypatch.setattr(W, "CELL_DRAWS", 16)
    rows = [(i, 1000.0 if i == 3 else 1.0) for i in range(50)]
    got = draws(spark, rows, 2000)
    assert got == plain_draws(rows, 2000) and sum(i == 3 for _, i in got) > 1800


def test_draws_follow_the_weights_and_the_seed(spark):
    rows = [(i, float(i)) for i in range(5)]
    got = draws(spark, rows, 20_000)
    share = [sum(j == i for _, j in got) / 20_000 for i in range(5)]
    assert share[0] == 0 and all(abs(share[i] - i / 10) < 0.015 for i in range(5))
    assert draws(spark, rows, 50, seed=1) != draws(spark, rows, 50, seed=2)


def test_draws_do_not_depend_on_partitions_and_carry_columns(spark):
    df = spark.createDataFrame([(i, i % 5 + 0.5, f"t{i}") for i in range(200)], "id long, w double, text string")
    a, b = (W.weighted_draws(df.repartition(p), "w", 300) for p in (1, 7))
    assert a.columns == ["draw", "id", "w", "text"]
    assert sorted(a.collect()) == sorted(b.collect()) and all(r["text"] == f"t{r['id']}" for r in a.collect())


@pytest.mark.parametrize("bad", [None, -1.0, float("nan"), float("inf")])
def test_bad_weights_raise(spark, bad):
    df = spark.createDataFrame([(1, 1.0), (2, bad)], "id long, w double")
    for call in (lambda: W.weighted_draws(df, "w", 3), lambda: W.weighted_without_replacement(df, "w", 1)):
        with pytest.raises(ValueError):
            call()


def test_no_weight_and_repeated_ids_raise(spark):
    zero = spark.createDataFrame([(1, 0.0)], "id long, w double")
    with pytest.raises(ValueError):
        W.weighted_draws(zero, "w", 3)
    with pytest.raises(ValueError):
        W.weighted_draws(zero.limit(0), "w", 3)
    twice = spark.createDataFrame([(1, 1.0), (1, 1.0)], "id long, w double")
    with pytest.raises(Exception, match="not unique"):
        W.weighted_draws(twice, "w", 3).collect()


def plain_without(rows, n, seed=42):
    keys = sorted((-math.log((int(md5(seed, "key", i)[:12], 16) + 1) / 2**48) / w, i) for i, w in rows if w > 0)
    return sorted(i for _, i in keys[:n])


@pytest.mark.parametrize("n", [0, 1, 7, 250, 999, 1000])
def test_without_replacement_equals_a_sort(spark, n):
    rows = [(i, [1.0, 0.001, 50.0, 1e9][i % 4]) for i in range(1000)] + [(2000, 0.0)]
    df = spark.createDataFrame(rows, "id long, w double").repartition(4)
    got = sorted(r["id"] for r in W.weighted_without_replacement(df, "w", n).collect())
    assert got == plain_without(rows, n)


def test_without_replacement_needs_enough_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 0.0)], "id long, w double")
    with pytest.raises(ValueError):
        W.weighted_without_replacement(df, "w", 2)
    assert [r["id"] for r in W.weighted_without_replacement(df, "w", 1).collect()] == [1]


def test_without_replacement_prefers_heavy_rows(spark):
    rows = [(i, 9.0 if i < 500 else 1.0) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, w double")
    got = [r["id"] for r in W.weighted_without_replacement(df, "w", 100).collect()]
    assert len(set(got)) == 100 and sum(i < 500 for i in got) > 75
