"""N-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from labelscope.llm import jaccard_tree as J

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = (text or "").translate(LOWER).encode().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                if a != b:
                    root[a], root[b] = (root[a], a) if rows[a][0] < rows[b][0] else (b, root[b])
    return sorted((rows[i][0], len(sets[i]), rows[find(i)][0]) for i in range(len(rows)))


def corpus(seed, families=12):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(300)] + ["É", "é"]
    passage = [rng.choice(words) for _ in range(60)]
    rows, i = [], 0
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.randint(5, 160))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 60)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            text = " ".join(copy)
            rows.append((i, text.upper() if rng.random() < 0.3 else text))
            i += rng.randint(1, 3)
    rng.shuffle(rows)
    return rows


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.near_components(docs).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == plain(rows)


def test_without_first_links_and_in_small_blocks(spark, monkeypatch):
    """The exact step alone finds everything, also when lists are cut into block pairs."""
    rows = corpus(5)
    none = "a long, b long"
    monkeypatch.setattr(J, "proposals", lambda classes, percent=75: classes.sparkSession.createDataFrame([], none))
    monkeypatch.setattr(J, "BLOCK", 2)
    monkeypatch.setattr(J, "COMMON_SAMPLE", 2)
    assert run(spark, rows) == plain(rows)


def test_edge_rows(spark):
    long = " ".join(f"u{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "\n"), (4, "Three small words"), (5, "three  small\nwords"), (6, "three small"),
            (7, long), (8, long + " more"), (9, "a b c d e"), (10, "A B c d e"), (11, "a b c d e f")]
    assert run(spark, rows) == plain(rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.near_components(empty).count() == 0


def test_repeated_rows_and_extra_columns(spark):
    docs = spark.createDataFrame([(3, "p q r s t u", 1), (3, "p q r s t u", 2), (2, "P q r s t u", 3), (None, "z", 4)],
                                 "doc_id long, text string, n_shingles int")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.near_components(docs).collect()]
    assert sorted(got, key=str) == sorted([(3, 2, 2), (3, 2, 2), (2, 2, 2), (None, 1, None)], key=str)


def test_rows_without_id_link_by_text(spark):
    from corpus_pipeline import near_duplicates

    base = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    rows = [(None, " ".join(base)), (7, " ".join([*base, "x"])), (9, " ".join([*base, "y"])), (None, " ".join(other)),
            (None, " ".join([*other, "x"])), (4, "nothing like the rest of them"), (None, None)]
    got = sorted(run_any(spark, rows), key=str)
    assert got == sorted([(None, 56, 7), (7, 57, 7), (9, 57, 7), (None, 56, None), (None, 57, None), (4, 2, 4), (None, 0, None)], key=str)
    kept = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "")[:1]) for r in kept) == [
        (False, 4, "n"), (False, 7, "w"), (True, 0, ""), (True, 0, "v")]


def run_any(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.near_components(docs).collect()]


def test_traversal_keeps_every_linking_pair():
    rng = np.random.default_rng(1)
    bases = [set(rng.integers(0, 10**6, 150).tolist()) for _ in range(12)]
    sets = [(b - set(rng.choice(list(b), 8, replace=False).tolist())) | set(rng.integers(0, 10**6, 6).tolist()) for b in bases for _ in range(5)]
    n = np.array([len(s) for s in sets])
    bits = np.zeros((len(sets), J.BITS), bool)
    for i, s in enumerate(sets):
        bits[i, [hash(("x", v)) % J.BITS for v in s]] = True
    maps = np.packbits(bits, axis=1).view(np.uint64)
    group = np.arange(len(sets))
    tree = J.SignatureTree(maps, n, group)
    a, b = J.dual_traversal(tree, tree, 75, same=True)
    found = {frozenset(p) for p in zip(a.tolist(), b.tolist())}
    links = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert links <= found and len(found) < len(sets) * (len(sets) - 1) // 4
