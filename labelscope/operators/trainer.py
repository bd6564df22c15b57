"""Training in epochs with a choice of loss (T5, T6, T7, IO10) and scoring of
texts with a saved model (T2).

The model is linear over hashed token counts. Features are staged once, dealt
to ``steps`` batches by a seeded hash of the row key and stored by batch, so a
step reads its own files only. A step is one Spark job: every task computes loss
and gradient of its rows in Arrow batches from the broadcast weights; gradients
travel as blocks of columns that are added up in ``BLOCKS`` tasks, and only the
summed gradient (classes x features doubles, whatever the data size) reaches
the driver, which clips it and applies AdamW under a cosine schedule.

Losses: ``ce`` (mean cross-entropy), ``weighted`` (each row times its class
weight) and ``focal`` (``(1 - pt) ** gamma * ce`` with ``pt = exp(-ce)``, the class
weights inside ``ce``). The epoch's loss is the mean of its batches' means (A20);
its training F1 is that of the predictions its steps made before their updates.

After every epoch the weights, the optimiser's moments and the history are
written to ``state_dir``; a run that finds them there goes on after the last
whole epoch, with the result of an uninterrupted run. Sums are taken in a fixed
order of the batch's files, so a repeated run over the same files is the same.

Rows with a null label or a label outside ``labels`` raise; null texts have no
tokens and are judged by the bias alone.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from labelscope.functions.hashing import hex_prefix_int, seeded_key
from labelscope.functions.text import as_text, metadata_prefix
from labelscope.session import ensure_checkpoint_dir

LOSSES = ("ce", "weighted", "focal")
#: Tasks that add gradients up.
BLOCKS = 16
#: Tokens whose feature a worker remembers.
CACHE_TOKENS = 1_000_000
# The optimiser's usual constants.
BETA1, BETA2, EPS = 0.9, 0.999, 1e-8

_FEATURE_OF: dict[int, dict[str, int]] = {}


def token_feature(token: str, dims: int) -> int:
    """Feature of a token: its MD5's first 8 hex digits modulo ``dims``."""
    return int(hashlib.md5(token.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % dims


def text_features(texts: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows ``(row, feature, value)``: token counts by feature, each row
    of length 1 (none for texts without tokens)."""
    known = _FEATURE_OF.setdefault(dims, {})
    lists = pc.split_pattern_regex(texts.fill_null("").cast(pa.large_string()), "[ \t\r\n]+")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    row = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists), np.int64))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    if len(known) + len(words) > CACHE_TOKENS:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = token_feature(w, dims) if w else -1
    feature = np.fromiter((known[w] for w in words), np.int64, len(words))[np.asarray(coded.indices, np.int64)]
    keep = feature >= 0
    pair, n = np.unique(row[keep] * dims + feature[keep], return_counts=True)
    row, feature = pair // dims, pair % dims
    norm = np.sqrt(np.bincount(row, weights=n.astype(float) ** 2, minlength=len(lists)))
    return row, feature, n / norm[row]


def _text(df: DataFrame, text_col: str, language_col: str | None):
    return metadata_prefix(text_col, language_col) if language_col and language_col in df.columns else as_text(text_col)


def feature_table(df: DataFrame, key: str, text_col: str, label_col: str, dims: int, steps: int, seed, path: str,
                  labels: Sequence[int], language_col: str | None = None) -> DataFrame:
    """``(step, y, feature, value)`` written by step; ``y`` is the label's place in ``labels``."""
    at = F.array_position(F.lit([int(x) for x in labels]), F.col(label_col).cast("int"))
    wrong = F.raise_error(F.concat(F.lit("label not in the list: "), F.coalesce(F.col(label_col).cast("string"), F.lit("null"))))
    y = F.when(at > 0, at - 1).otherwise(wrong.cast("bigint")).cast("int")
    step = F.pmod(hex_prefix_int(seeded_key(seed, F.lit("step"), key), 12), F.lit(int(steps)).cast("bigint")).cast("int")
    src = df.select(step.alias("step"), y.alias("y"), _text(df, text_col, language_col).alias("text"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, feature, value = text_features(batch.column(2), dims)
            first = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(first, pa.array(feature, pa.int32())),
                 pa.ListArray.from_arrays(first, pa.array(value))], ["step", "y", "feature", "value"])

    rows = src.mapInArrow(featurise, "step int, y int, feature array<int>, value array<double>")
    rows.write.mode("overwrite").partitionBy("step").parquet(path)
    schema = "y int, feature array<int>, value array<double>, step int"
    return df.sparkSession.read.schema(schema).parquet(path)


def sparse_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(y, row, feature, value)`` of a batch of the feature table."""
    y, feature, value = (batch.column(batch.schema.get_field_index(c)) for c in ("y", "feature", "value"))
    row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(feature), np.int64))
    return np.asarray(y), row, np.asarray(feature.flatten(), np.int64), np.asarray(value.flatten())


def logits_of(w: np.ndarray, n: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Rows of logits; the last column of ``w`` is the bias."""
    out = np.empty((n, len(w)))
    for k in range(len(w)):
        out[:, k] = np.bincount(row, weights=w[k, feature] * value, minlength=n) + w[k, -1]
    return out


def loss_and_slope(z: np.ndarray, y: np.ndarray, loss: str, alpha: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each row, and its derivative by the row's logits."""
    top = z.max(axis=1, keepdims=True)
    log_p = z - top - np.log(np.exp(z - top).sum(axis=1, keepdims=True))
    here = np.arange(len(y))
    weight = np.ones(len(y)) if loss == "ce" else alpha[y]
    ce = -weight * log_p[here, y]
    slope = np.exp(log_p) * weight[:, None]
    slope[here, y] -= weight
    if loss != "focal":
        return ce, slope
    pt = np.exp(-ce)
    rest = 1 - pt
    by_ce = rest ** gamma
    some = rest > 0
    by_ce[some] += gamma * rest[some] ** (gamma - 1) * pt[some] * ce[some]
    return rest ** gamma * ce, slope * by_ce[:, None]


def batch_gradient(rows: DataFrame, w: np.ndarray, loss: str, alpha: np.ndarray, gamma: float) -> tuple[np.ndarray, float, int, np.ndarray]:
    """Summed gradient, summed loss, rows and confusion counts of a batch."""
    classes, width = w.shape
    sent = rows.sparkSession.sparkContext.broadcast(w)
    size = -(-w.size // BLOCKS)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        g, totals = np.zeros(w.shape), np.zeros(2 + classes * classes)
        for batch in batches:
            y, row, feature, value = sparse_rows(batch)
            z = logits_of(w, len(y), row, feature, value)
            each, slope = loss_and_slope(z, y, loss, alpha, gamma)
            for k in range(classes):
                g[k, :-1] += np.bincount(feature, weights=slope[row, k] * value, minlength=width - 1)
            g[:, -1] += slope.sum(axis=0)
            totals[:2] += each.sum(), len(y)
            totals[2:] += np.bincount(y * classes + z.argmax(axis=1), minlength=classes * classes)
        if totals[1]:
            flat = g.ravel()
            parts = [flat[b * size: (b + 1) * size].tobytes() for b in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, BLOCKS), pa.int32()), pa.array([totals.tobytes(), *parts], pa.binary())],
                                             ["block", "sums"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(raw)
                sums[block] = sums[block] + x if block in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())],
                                         ["block", "sums"])

    parts = rows.select("y", "feature", "value").mapInArrow(partial, "block int, sums binary")
    parts = parts.withColumn("part", F.spark_partition_id()).repartition(BLOCKS + 1, "block").sortWithinPartitions("block", "part")
    got = {r["block"]: np.frombuffer(r["sums"]) for r in parts.select("block", "sums").mapInArrow(add_up, "block int, sums binary").collect()}
    sent.unpersist()
    if not got:
        return np.zeros(w.shape), 0.0, 0, np.zeros((classes, classes), np.int64)
    g = np.concatenate([got[b] for b in range(BLOCKS)]).reshape(w.shape)
    totals = got[-1]
    return g, float(totals[0]), int(totals[1]), totals[2:].reshape(classes, classes).astype(np.int64)


def confusion(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    """Confusion counts of the weights over a feature table."""
    classes = len(w)
    sent = rows.sparkSession.sparkContext.broadcast(w)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(classes * classes, np.int64)
        for batch in batches:
            y, row, feature, value = sparse_rows(batch)
            n += np.bincount(y * classes + logits_of(sent.value, len(y), row, feature, value).argmax(axis=1), minlength=classes * classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes * classes)), pa.array(n)], ["cell", "n"])

    cells = rows.select("y", "feature", "value").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(classes * classes, np.int64)
    for r in cells.collect():  # classes squared
        out[r["cell"]] = r["n"]
    sent.unpersist()
    return out.reshape(classes, classes)


def macro_f1_of(counts: np.ndarray) -> float:
    """M4 of confusion counts: the mean F1 of classes that occur on either side."""
    hit, seen = np.diag(counts), counts.sum(axis=0) + counts.sum(axis=1)
    return float((2 * hit[seen > 0] / seen[seen > 0]).mean()) if seen.any() else 0.0


def balanced_weights(counts: np.ndarray) -> np.ndarray:
    """A9/A11 over the classes present; absent ones get 0."""
    present = counts > 0
    return np.divide(counts.sum(), present.sum() * counts, out=np.zeros(len(counts)), where=present)


def cosine_rate(step: int, total: int, warm_up: int) -> float:
    """Share of the learning rate at a step (counted from 0)."""
    if step < warm_up:
        return step / max(1, warm_up)
    return max(0.0, 0.5 * (1 + math.cos(math.pi * (step - warm_up) / max(1, total - warm_up))))


class State:
    """Weights, moments, steps done and history."""

    def __init__(self, classes: int, dims: int):
        self.w, self.m, self.v = (np.zeros((classes, dims + 1)) for _ in range(3))
        self.steps, self.history = 0, []

    def update(self, g: np.ndarray, rate: float, decay: float, clip: float) -> None:
        """AdamW with the gradient clipped to the norm ``clip``."""
        self.steps += 1
        g = g * min(1.0, clip / (math.sqrt((g * g).sum()) + 1e-6))
        self.w *= 1 - rate * decay
        self.m = BETA1 * self.m + (1 - BETA1) * g
        self.v = BETA2 * self.v + (1 - BETA2) * g * g
        self.w -= rate / (1 - BETA1 ** self.steps) * self.m / (np.sqrt(self.v / (1 - BETA2 ** self.steps)) + EPS)

    def save(self, spark: SparkSession, path: str, meta: dict) -> None:
        """One row per class and array, and one of JSON."""
        rows = [(name, k, x[k].tolist(), None) for name, x in (("w", self.w), ("m", self.m), ("v", self.v)) for k in range(len(x))]
        rows.append(("meta", 0, None, json.dumps(meta | {"steps": self.steps, "history": self.history})))
        df = spark.createDataFrame(rows, "name string, class int, numbers array<double>, json string")
        df.coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> tuple[State, dict]:
        rows = spark.read.parquet(path).collect()  # three rows a class, and one
        meta = json.loads(next(r["json"] for r in rows if r["name"] == "meta"))
        out = cls(len(meta["labels"]), meta["dims"])
        for r in rows:
            if r["name"] != "meta":
                getattr(out, r["name"])[r["class"]] = r["numbers"]
        out.steps, out.history = meta.pop("steps"), meta.pop("history")
        return out, meta


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark committed a table at ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def train_epochs(spark: SparkSession, train: DataFrame, validation: DataFrame, key: str, text_col: str = "code", label_col: str = "label",
                 *, labels: Sequence[int], state_dir: str, epochs: int = 5, steps: int = 10, dims: int = 1 << 16, loss: str = "ce",
                 gamma: float = 2.0, rate: float = 0.1, decay: float = 0.01, clip: float = 1.0, warm_up: float = 0.1, seed=42,
                 language_col: str | None = None) -> tuple[DataFrame, str]:
    """Train and return ``(history, path of the best epoch's model)``. History
    rows: epoch, train_loss, train_f1, val_f1. The best epoch is the first with
    the highest validation F1 above 0 (the last epoch when none is)."""
    if loss not in LOSSES:
        raise ValueError(f"loss must be one of {LOSSES}")
    ensure_checkpoint_dir(spark)
    labels = [int(x) for x in labels]
    meta = {"labels": labels, "dims": dims, "loss": loss, "gamma": gamma, "rate": rate, "decay": decay, "clip": clip,
            "warm_up": warm_up, "steps_per_epoch": steps, "epochs": epochs, "seed": str(seed), "language_col": language_col}
    state = State(len(labels), dims)
    done = max((e for e in range(1, epochs + 1) if _exists(spark, f"{state_dir}/epoch-{e}")), default=0)
    if done:
        state, found = State.load(spark, f"{state_dir}/epoch-{done}")
        if found != meta:
            raise ValueError(f"{state_dir} holds a run with other parameters: {found}")
    paths = [f"{state_dir}/features-train", f"{state_dir}/features-validation"]
    if done < epochs:
        rows, held = (
            spark.read.schema("y int, feature array<int>, value array<double>, step int").parquet(p) if _exists(spark, p)
            else feature_table(df, key, text_col, label_col, dims, n, seed, p, labels, language_col)
            for df, n, p in ((train, steps, paths[0]), (validation, 1, paths[1])))
        counts = np.zeros(len(labels), np.int64)
        for r in rows.groupBy("y").count().collect():  # one row a class
            counts[r["y"]] = r["count"]
        alpha = balanced_weights(counts)
    total = epochs * steps
    for epoch in range(done + 1, epochs + 1):
        losses, seen = [], np.zeros((len(labels), len(labels)), np.int64)
        for s in range(steps):
            g, loss_sum, n, hits = batch_gradient(rows.where(F.col("step") == s), state.w, loss, alpha, gamma)
            if n:
                losses.append(loss_sum / n)
                seen += hits
                g /= n
            state.update(g, rate * cosine_rate(state.steps, total, int(warm_up * total)), decay, clip)
        state.history.append([epoch, float(np.mean(losses)) if losses else 0.0, macro_f1_of(seen), macro_f1_of(confusion(held, state.w))])
        state.save(spark, f"{state_dir}/epoch-{epoch}", meta)
    history = spark.createDataFrame([tuple(h) for h in state.history], "epoch int, train_loss double, train_f1 double, val_f1 double")
    best = max(state.history, key=lambda h: (h[3], -h[0]))
    return history, f"{state_dir}/epoch-{best[0] if best[3] > 0 else epochs}"


def score_texts(spark: SparkSession, model_path: str, df: DataFrame, key: str, text_col: str = "code", keep: Sequence[str] = (),
                batch_size: int = 4096) -> DataFrame:
    """``(key, *keep, logits, y_pred)`` of texts by a saved model, loaded once per
    worker; null texts are judged by the bias alone."""
    from pyspark.ml.functions import predict_batch_udf

    state, meta = State.load(spark, model_path)
    sent = spark.sparkContext.broadcast(state.w)  # classes x features doubles
    dims, labels = meta["dims"], meta["labels"]

    def load():
        w = sent.value

        def predict(texts: np.ndarray) -> np.ndarray:
            return logits_of(w, len(texts), *text_features(pa.array(texts, pa.large_string()), dims))

        return predict

    judge = predict_batch_udf(load, return_type=ArrayType(DoubleType()), batch_size=batch_size)
    scored = df.select(key, *keep, judge(_text(df, text_col, meta["language_col"])).alias("logits"))
    place = F.array_position("logits", F.array_max("logits")).cast("int")
    return scored.withColumn("y_pred", F.element_at(F.lit(labels), place).cast("int"))
