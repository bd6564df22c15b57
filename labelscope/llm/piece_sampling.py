"""SentencePiece sampling: forward filtering, backward sampling over the piece
lattice, seeded by row key, with lossless decoding.

Spaces are the only word marks: no piece of the model holds a mark after
another character, so the lattice falls apart where a space follows a
non-space, and each of these units can be sampled by itself. Per batch the
distinct units get their lattice once: ids of all pieces at all places, and
the forward sums over their weights. Every occurrence is then sampled backward
from its end, all occurrences of a batch in step; the uniform number of a draw
is a hash of (row key, unit number in the text, draw number), so a text has
the same segmentation in any batch, partition or retry.

Weights: ``theta * score`` for unigram models; for BPE models, whose scores
are negative merge ranks, ``-theta * log(2 + rank)``. Characters without a piece
(and a literal U+2581) become byte pieces. Decoding joins the pieces' bytes
and drops the leading mark that encoding adds, which gives back every text
byte for byte.

Defined results: null and empty texts have no pieces and decode to the empty
text; a null row key is a key of its own; equal rows get equal segmentations;
whole texts are sampled, however long; extra columns pass through unless named
like a result column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm._text import mix, text_bytes, text_slices

#: Bytes of text whose lattices a task holds at once (a longer text alone).
LATTICE_BYTES = 1 << 20
THETA = 1.0
_LOADED: dict = {}
_UNKNOWN = 1 << 24  # a character without a piece, plus its code point
_K = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


def load(path: str, theta: float = THETA) -> "Sampler":
    if (path, theta) not in _LOADED:
        _LOADED[path, theta] = Sampler(path, theta)
    return _LOADED[path, theta]


class Sampler:
    """Piece tables of a model: hashes of all pieces and of all their prefixes."""

    def __init__(self, path: str, theta: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size = n
        self.bytes = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        normal: list[tuple[str, int]] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                piece = piece.replace("▁", " ")
                normal.append((piece, i))
                self.bytes[i] = piece.encode("utf-8")
        if any(" " in p.lstrip(" ") for p, _ in normal):
            raise ValueError("a piece holds a space after another character")
        score = np.array([sp.get_score(i) for _, i in normal], np.float64)
        ranks = len(score) > 2 and bool((score == np.round(score)).all() and score.min() < -100)
        weight = -np.log(2.0 - np.maximum(score, -float(n))) if ranks else score
        weight = theta * (weight - weight.max())
        self.weight = np.zeros(n)
        self.weight[[i for _, i in normal]] = np.exp(weight)
        self.unknown_weight = float(np.exp(weight.min() - 1.0))
        self.longest = max(len(p) for p, _ in normal)
        # tables by length: sorted hashes with piece ids, and which hashes are prefixes
        self.table = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))]
        self.prefix = [np.zeros(1 << _FILTER_BITS, bool) for _ in range(self.longest + 1)]
        for size in range(1, self.longest + 1):
            own = [(p, i) for p, i in normal if len(p) == size]
            h = self._hash([p for p, _ in own], size)
            order = np.argsort(h)
            self.table.append((h[order], np.array([i for _, i in own], np.int32)[order]))
            longer = sorted({p[:size] for p, _ in normal if len(p) >= size})
            self.prefix[size][self._hash(longer, size) >> np.uint64(64 - _FILTER_BITS)] = True
        flat = b"".join(self.bytes)
        self.flat = np.frombuffer(flat, np.uint8)
        self.len = np.array([len(b) for b in self.bytes], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.len)])[:-1]

    @staticmethod
    def _hash(pieces: list[str], size: int) -> np.ndarray:
        if not pieces:
            return np.zeros(0, np.uint64)
        cp = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).reshape(-1, size).astype(np.uint64)
        h = np.zeros(len(pieces), np.uint64)
        for k in range(size):
            h = h * _K + cp[:, k] + np.uint64(1)
        return mix(h)

    def _lattice(self, cp: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ids[L - 1, i]`` and its weight: the piece of ``L`` characters at place
        ``i``, or -1 and 0. ``room`` is the number of characters to the unit's end."""
        n = len(cp)
        ids = np.full((self.longest, n), -1, np.int32)
        weight = np.zeros((self.longest, n))
        live = np.arange(n)
        h = np.zeros(n, np.uint64)
        used = 0
        for size in range(1, self.longest + 1):
            fits = room[live] >= size
            live, h = live[fits], h[fits]
            if not len(live):
                break
            h = h * _K + cp[live + size - 1] + np.uint64(1)
            key = mix(h)
            ok = self.prefix[size][key >> np.uint64(64 - _FILTER_BITS)]
            live, h, key = live[ok], h[ok], key[ok]
            table, piece = self.table[size]
            if len(table) and len(live):
                k = np.minimum(np.searchsorted(table, key), len(table) - 1)
                hit = table[k] == key
                ids[size - 1, live[hit]] = piece[k[hit]]
                weight[size - 1, live[hit]] = self.weight[piece[k[hit]]]
                used = size if hit.any() else used
        alone = np.flatnonzero(ids[0] < 0)
        ids[0, alone] = _UNKNOWN + cp[alone].astype(np.int32)
        weight[0, alone] = self.unknown_weight
        used = max(used, 1)
        return ids[:used], weight[:used]

    def encode(self, col: pa.Array, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled piece ids of all texts, and the offsets of each text's ids."""
        data, off = text_bytes(col)
        some = np.diff(off) > 0
        if not some.any():
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        # one leading space for each text that is not empty
        data = np.insert(data, off[:-1][some], 32)
        off = off + np.concatenate([[0], np.cumsum(some)])
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = (data[1:] == 32) & (data[:-1] != 32)
        edge[off] = True
        cuts = np.flatnonzero(edge)
        units = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1,
                                      [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        which = np.asarray(units.indices)
        raw, ends = text_bytes(units.dictionary)
        try:
            cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            begin = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[ends]
        except UnicodeDecodeError:  # an invalid byte counts as a character of its own
            texts = [u.decode("utf-8", "surrogateescape") for u in units.dictionary.to_pylist()]
            cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
            begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        cp, lens, start = cp.astype(np.uint64), np.diff(begin), begin[:-1]
        room = np.repeat(begin[1:], lens) - np.arange(len(cp))
        ids, weight = self._lattice(cp, room)
        # longest unit first: the units that reach a character number are a prefix
        order = np.argsort(-lens, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        lens, start = lens[order], start[order]
        place, cumulative = self._forward(weight, start, lens)
        doc_first = np.searchsorted(cuts, off)
        return self._backward(ids, start, lens, place, cumulative, rank[which], doc_first, seeds)

    def _forward(self, weight: np.ndarray, start: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cumulative probability of each last-piece length, at every place after
        a character: row ``place[t - 1] + u`` is unit ``u`` after ``t`` characters."""
        top, most = int(lens[0]), len(weight)
        reach = len(lens) - np.searchsorted(lens[::-1], np.arange(top + 1))  # units of at least t characters
        place = np.concatenate([[0], np.cumsum(reach[1:])])
        cumulative = np.zeros((int(place[-1]), most), np.float32)
        sums: list[np.ndarray] = [np.ones(len(lens))]  # the last forward sums, up to a factor per unit
        for t in range(1, top + 1):
            m = int(reach[t])
            part = np.zeros((m, most))
            total = np.zeros(m)
            for s in range(1, most + 1):
                if s <= t:
                    total += sums[len(sums) - s][:m] * weight[s - 1, start[:m] + (t - s)]
                part[:, s - 1] = total
            cumulative[place[t - 1]: place[t - 1] + m] = part / total[:, None]
            sums.append(total)
            if len(sums) > most:
                sums.pop(0)
            if t % 16 == 0:  # only ratios matter: keep the sums away from underflow
                for past in sums:
                    past[:m] /= total
        return place, cumulative

    def _backward(self, ids, start, lens, place, cumulative, unit, doc_first, seeds):
        occurrences = len(unit)
        doc = np.repeat(np.arange(len(doc_first) - 1), np.diff(doc_first))
        number = (np.arange(occurrences) - doc_first[doc]).astype(np.uint64)
        key = mix(seeds[doc] + number * np.uint64(0xD6E8FEB86659FD93))
        live, at = np.arange(occurrences), lens[unit].copy()
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        steps = np.zeros(occurrences, np.int64)
        draw = 0
        while len(live):
            draw += 1
            u = (mix(key[live] + np.uint64(draw * int(_K) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0 ** -24)
            row = cumulative[place[at[live] - 1] + unit[live]]
            size = np.minimum(np.count_nonzero(row <= u[:, None], axis=1) + 1, len(ids))
            begin = at[live] - size
            # rounding may fall on a length without a piece: take the next shorter one that has one
            got = ids[size - 1, start[unit[live]] + begin]
            while (bad := np.flatnonzero((got < 0) | (begin < 0))).size:
                size[bad] -= 1
                begin[bad] = at[live[bad]] - size[bad]
                got[bad] = ids[size[bad] - 1, start[unit[live[bad]]] + begin[bad]]
            taken.append((live, got))
            at[live] = begin
            steps[live] += 1
            live = live[begin > 0]
        first = np.concatenate([[0], np.cumsum(steps)])
        out = np.empty(int(first[-1]), np.int32)
        for k, (who, got) in enumerate(taken):  # draws run from the end of the unit
            out[first[who + 1] - 1 - k] = got
        # characters without a piece become their bytes
        offsets = first[doc_first]
        odd = np.flatnonzero(out >= _UNKNOWN)
        if len(odd):
            raw = [chr(c).encode("utf-8", "surrogateescape") if 0xDC80 <= c <= 0xDCFF else chr(c).encode("utf-8", "surrogatepass")
                   for c in (out[odd] - _UNKNOWN).tolist()]
            width = np.ones(len(out), np.int64)
            width[odd] = [len(b) for b in raw]
            ends = np.concatenate([[0], np.cumsum(width)])
            wide = np.repeat(out, width)
            body = np.frombuffer(b"".join(raw), np.uint8)
            wide[wide >= _UNKNOWN] = self.byte_id[body]
            out, offsets = wide, ends[offsets]
        return out, offsets

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts whose piece ids are given, and their offsets."""
        width = self.len[ids]
        ends = np.concatenate([[0], np.cumsum(width)])
        data = self.flat[np.repeat(self.at[ids] - ends[:-1], width) + np.arange(int(ends[-1]))]
        off = ends[offsets]
        some = np.diff(off) > 0
        data = np.delete(data, off[:-1][some])  # the mark that encoding put in front
        return data, off - np.concatenate([[0], np.cumsum(some)])


def _source(docs: DataFrame, text_col: str, key_col: str, seed: int, carry: list[str]) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col(key_col).cast("string"), F.lit("\u0000null")))
    return docs.select(*carry, key.alias("__seed"), text.alias("__text"))


def _schema(df: DataFrame, extra: str) -> str:
    own = (f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in ("__seed", "__text"))
    return ", ".join([*own, extra])


def sample_encode(docs: DataFrame, model_path: str, key_col: str = "doc_id", text_col: str = "text", seed: int = 42,
                  theta: float = THETA, carry: list[str] | None = None, name: str = "piece_ids") -> DataFrame:
    """``docs`` with a sampled segmentation as an array of piece ids; no shuffle.
    Every batch is decoded again and must give its texts back."""
    carry = [c for c in (docs.columns if carry is None else carry) if c != name]
    src = _source(docs, text_col, key_col, seed, carry)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = load(model_path, theta)
        for batch in batches:
            for part in text_slices(batch, "__text", LATTICE_BYTES):
                k = part.num_columns
                seeds = np.asarray(part.column(k - 2)).astype(np.int64).view(np.uint64)
                ids, off = sampler.encode(part.column(k - 1), seeds)
                back, text = sampler.decode(ids, off), text_bytes(part.column(k - 1))
                if not all(np.array_equal(x, y) for x, y in zip(back, text, strict=True)):
                    raise ValueError("decoding does not give the text back")
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(k - 2)), lists], [*carry, name])

    return src.mapInArrow(encode, _schema(src, f"`{name}` array<int>"))


def decode(rows: DataFrame, model_path: str, ids_col: str = "piece_ids", name: str = "text",
           theta: float = THETA) -> DataFrame:
    """``rows`` with the text that the piece ids spell; null ids give null."""
    carry = [c for c in rows.columns if c != name]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != name), f"`{name}` binary"])
    where = carry.index(ids_col)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = load(model_path, theta)
        for batch in batches:
            lists = batch.column(where)
            flat = np.asarray(lists.flatten())
            n = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
            data, off = sampler.decode(flat, np.concatenate([[0], np.cumsum(n)]))
            text = [None if not lists[i].is_valid else data[off[i]: off[i + 1]].tobytes() for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.binary())], [*carry, name])

    return rows.select(*carry).mapInArrow(spell, schema).withColumn(name, F.col(name).cast("string"))


def sample_digest(docs: DataFrame, model_path: str, key_col: str = "doc_id", text_col: str = "text", seed: int = 42,
                  theta: float = THETA, carry: list[str] | None = None) -> DataFrame:
    """Encode, decode and compare in one pass: ``n_bytes``, ``n_pieces``,
    ``pieces_sha256`` (of the ids as little-endian 32-bit numbers) and
    ``lossless`` (the decoded bytes equal the text)."""
    names = ["n_bytes", "n_pieces", "pieces_sha256", "lossless"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in names]
    src = _source(docs, text_col, key_col, seed, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = load(model_path, theta)
        for batch in batches:
            for part in text_slices(batch, "__text", LATTICE_BYTES):
                k = part.num_columns
                seeds = np.asarray(part.column(k - 2)).astype(np.int64).view(np.uint64)
                text = part.column(k - 1)
                ids, off = sampler.encode(text, seeds)
                back, ends = sampler.decode(ids, off)
                data, own = text_bytes(text)
                same = [ends[i + 1] - ends[i] == own[i + 1] - own[i]
                        and np.array_equal(back[ends[i]: ends[i + 1]], data[own[i]: own[i + 1]]) for i in range(len(text))]
                raw = ids.astype("<i4")
                sha = [hashlib.sha256(raw[off[i]: off[i + 1]].tobytes()).hexdigest() for i in range(len(text))]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(k - 2)), pa.array(np.diff(own)), pa.array(np.diff(off)),
                     pa.array(sha), pa.array(same, pa.bool_())], [*carry, *names])

    return src.mapInArrow(run, _schema(src, "n_bytes long, n_pieces long, pieces_sha256 string, lossless boolean"))
