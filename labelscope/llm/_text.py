"""Vectorised word views over Arrow text batches.

Words are the maximal runs outside space and U+0009-U+000D. A view covers
whole documents, never a prefix; batches are cut only between documents, so
memory is bounded by ``SLICE_BYTES`` or by the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task (a longer document alone).
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_slices(batch: pa.RecordBatch, column: str = "text",
                limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch between rows into pieces of about ``limit`` text bytes."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(column))
    ends = np.asarray(_offsets(col)[1:], dtype=np.int64)
    lo, base = 0, int(_offsets(col)[0])
    while lo < n:
        hi = int(np.searchsorted(ends, base + limit, side="right"))
        hi = min(max(hi, lo + 1), n)
        yield batch.slice(lo, hi - lo)
        lo, base = hi, int(ends[hi - 1])


def _offsets(col: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    kind = np.int64 if wide else np.int32
    buf = col.buffers()[1]
    if buf is None or len(col) == 0:
        return np.zeros(len(col) + 1, dtype=kind)
    return np.frombuffer(buf, dtype=kind)[col.offset: col.offset + len(col) + 1]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the whole column and the row offsets into them (nulls are empty)."""
    off = _offsets(col).astype(np.int64)
    buf = col.buffers()[2]
    if buf is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(buf, dtype=np.uint8)[off[0]: off[-1]]
    off = off - off[0]
    if col.null_count:
        nulls = np.asarray(col.is_null())
        if (np.diff(off)[nulls] > 0).any():  # bytes under a null slot are not text
            return text_bytes(col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else ""))
    return data, off


class Words:
    """Words of a text column: document ``i`` owns words
    ``first[i]:first[i + 1]``; ``start`` and ``end`` are byte positions in
    ``data``."""

    def __init__(self, col: pa.Array, lower: bool = False):
        data, off = text_bytes(col)
        if lower and len(data):
            data = _LOWER[data]
        self.data, self.off, self.docs = data, off, len(col)
        if not len(data):
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(len(col) + 1, np.int64)
            return
        word = ~_SPACE[data]
        edge = np.empty(len(data) + 1, dtype=bool)
        edge[1:-1] = word[1:] != word[:-1]
        edge[0], edge[-1] = word[0], word[-1]
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        both = cut[word[cut] & word[cut - 1]]  # a word ends and another starts at a document border
        edge[both] = False
        at = np.flatnonzero(edge)
        start, end = at[0::2], at[1::2]
        if len(both):
            both = np.unique(both)
            start = np.sort(np.concatenate([start, both]))
            end = np.sort(np.concatenate([end, both]))
        self.start, self.end = start, end
        self.first = np.searchsorted(start, off).astype(np.int64)
        self._word = word

    def tokens(self) -> pa.Array:
        """All words in order."""
        if not len(self.start):
            return pa.array([], pa.binary())
        ends = np.zeros(len(self.start) + 1, dtype=np.int64)
        np.cumsum(self.end - self.start, out=ends[1:])
        small = ends[-1] < 2**31
        return pa.Array.from_buffers(
            pa.binary() if small else pa.large_binary(), len(self.start),
            [None, pa.py_buffer(ends.astype(np.int32) if small else ends), pa.py_buffer(self.data[self._word])])

    def encode(self) -> tuple[np.ndarray, pa.Array]:
        """Exact dictionary coding: a code per word, and the distinct words."""
        if not len(self.start):
            return np.zeros(0, np.int32), pa.array([], pa.binary())
        enc = self.tokens().dictionary_encode()
        return np.asarray(enc.indices), enc.dictionary

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.counts)

    def hashes(self) -> np.ndarray:
        """Stable 64-bit hash of each word."""
        return byte_run_hashes(self.data, self.start, self.end)


#: Per-byte random values and the odd base of the polynomial word hash.
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def byte_run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray,
                    block: int = 1 << 20) -> np.ndarray:
    """64-bit hash of the byte runs ``data[start:end]``, which must be in order
    and disjoint: prefix sums of a polynomial, taken block by block."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = max(int(np.searchsorted(end, base + block, side="right")), i + 1)
        n = int(end[j - 1]) - base
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data[base: base + n]] * _powers(_BASE, n), out=sums[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * _powers(_UNBASE, n + 1)[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every run of ``size`` consecutive word hashes (document
    borders are the caller's concern); empty when there are too few words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    k = np.uint64(0x9E3779B97F4A7C15)
    for i in range(size):
        h = h * k + words[i: i + n]
        h ^= h >> np.uint64(29)
    return mix(h)


def inside(first: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of the ``n`` window starts lie whole inside one document."""
    ok = np.ones(max(n, 0), dtype=bool)
    if n <= 0:
        return ok
    for b in first[1:-1]:
        ok[max(b - size + 1, 0): min(b, n)] = False
    return ok


def covered(marks: np.ndarray, total: int, size: int) -> np.ndarray:
    """Words covered by the windows (start positions marked True) of ``size`` words."""
    d = np.zeros(total + 1, np.int32)
    at = np.flatnonzero(marks)
    np.add.at(d, at, 1)
    np.add.at(d, np.minimum(at + size, total), -1)
    return np.cumsum(d[:-1]) > 0


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of per-word values by document."""
    c = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype != np.float64 else np.float64)
    np.cumsum(values, out=c[1:])
    return c[first[1:]] - c[first[:-1]]
