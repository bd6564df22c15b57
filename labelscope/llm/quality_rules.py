"""Quality rules: counted base rules and a calibrated hashed n-gram classifier.

Features are hashed word unigrams, word bigrams, character 3-grams and
character 4-grams, each group as frequencies of its own block of buckets. A
logistic regression is fitted on a bounded, class-stratified sample of the
labelled rows (``max_train``, a parameter; the smallest row hashes of each
class), Platt-calibrated on a held-out fifth of it with the class weights of
all labelled rows, and applied in Arrow batches against fixed thresholds.

Defined results: null and empty texts have no words and fail the base rules;
rows whose label is null or not 0/1 and labelled ids without a document are
not used; without rows of both classes there is no model and the verdict of
every document that passes the base rules is "keep" (``p_quality`` null);
repeated rows are judged one by one; extra columns are passed through, except
those named like a result column, which the result replaces.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm._text import Words, covered, inside, mix, per_doc, text_slices, window_hashes

#: Labelled rows used for the fit, at most (half of it per class).
MAX_TRAIN = 3000
#: Buckets of each feature group.
BUCKET_BITS = 16
#: A document is kept when its calibrated probability reaches this.
KEEP_PROBABILITY = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
SYMBOLS = b"#*$%&|<>"

GROUPS = 4
_SCALE = 30.0
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True

RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, p_quality double, kept boolean")


# --- base rules -------------------------------------------------------------

def count_dup_lines(data: np.ndarray, off: np.ndarray, words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same document."""
    docs = len(off) - 1
    if not len(words.start):
        return np.zeros(docs, np.int64)
    newline = np.flatnonzero(data == 10)
    # line starts: document starts and the byte after each newline
    start = np.union1d(off[:-1], newline + 1)
    start = start[start < len(data)]
    end = np.append(start[1:], len(data))
    end = end - (data[end - 1] == 10)
    has = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[has], end[has]
    doc = np.searchsorted(off, start, side="right") - 1
    # exact comparison: the lines as one binary array, dictionary-coded
    mask = np.zeros(len(data) + 1, np.int8)
    mask[start] += 1
    np.subtract.at(mask, end, 1)
    body = data[np.cumsum(mask[:-1], dtype=np.int8).astype(bool)]
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=ends[1:])
    small = ends[-1] < 2**31
    lines = pa.Array.from_buffers(pa.binary() if small else pa.large_binary(), len(start), [
        None, pa.py_buffer(ends.astype(np.int32) if small else ends), pa.py_buffer(body)])
    code = np.asarray(lines.dictionary_encode().indices).astype(np.int64)
    distinct = np.unique(doc.astype(np.int64) * (len(start) + 1) + code) // (len(start) + 1)
    return np.bincount(doc, minlength=docs) - np.bincount(distinct, minlength=docs)


def repeated_windows(words: Words, hashes: np.ndarray, size: int) -> np.ndarray:
    """Window starts whose word sequence occurs twice or more in its document."""
    win = window_hashes(hashes, size)
    if not len(win):
        return np.zeros(0, bool)
    ok = inside(words.first, len(win), size)
    doc = words.doc_of_word()[: len(win)]
    at = np.flatnonzero(ok)
    key = mix(win[at] + doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    marks = np.zeros(len(win), bool)
    marks[at[order[1:][same]]] = True
    marks[at[order[:-1][same]]] = True
    return marks


def base_counts(words: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    data, off = words.data, words.off

    def by_doc(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[off[1:]] - c[off[:-1]]

    lead = (data & 0xC0) != 0x80
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    marks = repeated_windows(words, hashes, REPEAT_WINDOW)
    repeat = covered(marks, len(words.start), REPEAT_WINDOW) if len(marks) else np.zeros(len(words.start), bool)
    return {"n_words": words.counts.astype(np.int64),
            "word_chars": by_doc(lead & ~space[data]),
            "n_symbols": by_doc(_SYMBOL[data]),
            "n_dup_lines": count_dup_lines(data, off, words),
            "n_repeat_words": per_doc(repeat.astype(np.int64), words.first)}


# --- features ---------------------------------------------------------------

def _bucket(h: np.ndarray, group: int) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) + (group << BUCKET_BITS)


def feature_groups(words: Words, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each feature group: bucket of every occurrence, and the offsets of
    each document's occurrences (whole documents, occurrences never cross one)."""
    data, off = words.data, words.off
    yield _bucket(mix(hashes), 0), words.first
    pair = window_hashes(hashes, 2)
    ok = np.flatnonzero(inside(words.first, len(pair), 2))
    yield _bucket(pair[ok], 1), np.searchsorted(ok, words.first)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    text = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    if len(text) != len(lead):  # invalid UTF-8: fall back to bytes as characters
        text, lead = data.astype(np.uint32), np.arange(len(data))
    cp = text.astype(np.uint64)
    first = np.searchsorted(lead, off)
    for group, size in ((2, 3), (3, 4)):
        n = len(cp) - size + 1
        if n <= 0:
            yield np.zeros(0, np.int64), np.zeros(len(off), np.int64)
            continue
        h = np.zeros(n, np.uint64)
        for i in range(size):
            h = (h + cp[i: i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        ok = inside(first, n, size)
        where = np.flatnonzero(ok)
        yield _bucket(h[where] if len(where) < n else h, group), np.searchsorted(where, first)


def sparse_rows(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature vector of each document: bucket ids and frequencies."""
    words = Words(col)
    hashes = words.hashes()
    rows: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(words.docs)]
    for bucket, first in feature_groups(words, hashes):
        for i in range(words.docs):
            own = bucket[first[i]: first[i + 1]]
            if len(own):
                ids, n = np.unique(own, return_counts=True)
                rows[i].append((ids.astype(np.int32), (n * (_SCALE / len(own))).astype(np.float32)))
    return [(np.concatenate([a for a, _ in r]) if r else np.zeros(0, np.int32),
             np.concatenate([b for _, b in r]) if r else np.zeros(0, np.float32)) for r in rows]


# --- model ------------------------------------------------------------------

@dataclass
class Model:
    """Bucket weights, intercept and the calibration ``sigmoid(a * score + b)``."""

    weights: np.ndarray
    intercept: float
    a: float
    b: float

    def scores(self, words: Words, hashes: np.ndarray) -> np.ndarray:
        total = np.full(words.docs, self.intercept)
        for bucket, first in feature_groups(words, hashes):
            got = per_doc(self.weights[bucket].astype(np.float64), first)
            total += _SCALE * got / np.maximum(np.diff(first), 1)
        return total

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.a * score + self.b, -500, 500)))


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray,
                 l2: float = 1e-3, steps: int = 120) -> tuple[np.ndarray, float]:
    """Full-batch logistic regression by accelerated gradient descent."""
    size = GROUPS << BUCKET_BITS
    ids = np.concatenate([r[0] for r in rows])
    val = np.concatenate([r[1] for r in rows])
    lens = np.array([len(r[0]) for r in rows])
    first = np.concatenate([[0], np.cumsum(lens)])
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), lens)
    n = len(rows)
    w, b = np.zeros(size), 0.0
    vw, vb = w.copy(), b
    norm = np.add.reduceat(val * val, first[:-1]) * (lens > 0) if len(val) else np.zeros(n)
    rate = 4.0 / (float(np.max(norm, initial=1.0)) + 1.0)
    t = 1.0
    for _ in range(steps):
        z = per_doc(vw[ids] * val, first) + vb
        g = (1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))) - y) / n
        gw = np.bincount(ids, weights=g[doc] * val, minlength=size) + l2 * vw
        nw, nb = vw - rate * n ** 0.5 * gw, vb - rate * n ** 0.5 * g.sum()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = nw, nb, t2
    return w, b


def fit_platt(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted Platt scaling with smoothed targets (Newton steps)."""
    pos, neg = float(weight[y == 1].sum()), float(weight[y == 0].sum())
    if not pos or not neg:
        return 1.0, 0.0
    n = len(y) / (pos + neg)
    target = np.where(y == 1, (pos * n + 1) / (pos * n + 2), 1 / (neg * n + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        d, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        g = np.array([(d * score).sum() + 1e-3 * (a - 1), d.sum()])
        m = np.array([[(h * score * score).sum() + 1e-3, (h * score).sum()], [(h * score).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    return a, b


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
        label_col: str = "quality", max_train: int = MAX_TRAIN) -> Model | None:
    """Fit on at most ``max_train`` labelled documents, in one task."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return None
    order = F.xxhash64("id")
    parts = [known.where(F.col("y") == c).orderBy(order, "id").limit(max_train // 2) for c in (0, 1)]
    # at most max_train (id, label) rows: broadcast, so only the sample's texts move
    sample = F.broadcast(parts[0].unionByName(parts[1]))
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
            .join(sample, "id").withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(5)).cast("int")))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, y, fold = [], [], []
        for batch in batches:
            for part in text_slices(batch):
                got += sparse_rows(part.column("text"))
                y += part.column("y").to_pylist()
                fold += part.column("fold").to_pylist()
        y, fold = np.array(y, dtype=np.float64), np.array(fold)
        blob = b""
        if (y == 0).any() and (y == 1).any():
            learn = np.flatnonzero(fold > 0)
            check = np.flatnonzero(fold == 0)
            if len(set(y[learn])) < 2:
                learn = np.arange(len(y))
            w, b = fit_logistic([got[i] for i in learn], y[learn])
            check = check if len(set(y[check])) == 2 else learn
            score = np.array([w[got[i][0]] @ got[i][1] + b for i in check])
            share = {c: totals[c] / max((y[check] == c).sum(), 1) for c in (0, 1)}
            weight = np.where(y[check] == 1, share[1], share[0])
            a, c = fit_platt(score, y[check], weight / weight.mean())
            out = io.BytesIO()
            np.savez(out, w=w.astype(np.float32), b=b, a=a, c=c)
            blob = out.getvalue()
        yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["model"])

    # sorted, so the fit does not depend on task order
    blob = rows.orderBy("id").coalesce(1).mapInArrow(train, "model binary").first()["model"]
    if not blob:
        return None
    z = np.load(io.BytesIO(bytes(blob)))
    return Model(z["w"], float(z["b"]), float(z["a"]), float(z["c"]))


def judge(docs: DataFrame, model: Model | None, text_col: str = "text",
          keep_probability: float = KEEP_PROBABILITY, carry: list[str] | None = None) -> DataFrame:
    """Base counts, probability and verdict of every document; no shuffle."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in names]
    src = docs.select(*carry, F.col(text_col).cast("binary").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__text")
    schema = ", ".join(x for x in (schema, RESULT) if x)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__text"):
                words = Words(part.column(part.num_columns - 1))
                hashes = words.hashes()
                c = base_counts(words, hashes)
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
                if model is None:
                    p, kept = pa.nulls(words.docs, pa.float64()), ~failed
                else:
                    prob = model.probability(model.scores(words, hashes))
                    p, kept = pa.array(prob), ~failed & (prob >= keep_probability)
                arrays = [part.column(i) for i in range(part.num_columns - 1)]
                arrays += [pa.array(c[n]) for n in names[:5]] + [pa.array(failed), p, pa.array(kept)]
                yield pa.RecordBatch.from_arrays(arrays, [*carry, *names])

    return src.mapInArrow(score, schema)
