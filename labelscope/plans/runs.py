"""End-to-end runs of the three flows, each a chain of Spark jobs with file hand-offs.

T9 ``profile_run``: the corpus profile tables of a training split and the
   size and class distribution of a validation split, written as CSV / text.
E1 ``rebalance_run``: scan -> balance (R7/R8/R9) -> Parquet (IO4) -> reports
   (A13, A14) computed from the *written* table, so the lineage is cut there.
E2 ``train_run``: fit candidates (T5), save the best pipeline (IO10), write the
   history (T7, IO8) and report the best-epoch row (W-2).
E3 ``predict_run`` -> ``submission_run`` -> ``validate_submission``: score (T2)
   -> predictions table (T3) -> CSV (IO5) -> test IDs joined by position (T4)
   -> CSV -> read back as text (IO2) -> checks (V1-V7).
T12 ``history_run``: a history JSON array -> curve table, checkpoint events, best epoch.
T11 ``compare_run``: two prediction CSVs -> agreement row and differing rows.
T8 ``evaluation_run``: predictions meet truth once (J1); the narrow joined
   table is persisted and its pair counts (<= K^2 rows) are checkpointed into
   ``spark.checkpoint.dir``; every output derives from those: report text
   (IO9), metrics JSON (IO7), confusion matrices (IO5), per-class F1 series,
   dense distribution and per-group accuracy tables (IO6).

Paths are the caller's (a shared folder on a cluster). Small outputs whose
size is bounded by the number of classes or groups are written as one file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.functions.labels import LABEL_NAMES
from labelscope.operators import (groups, history as hist, metrics, model, profile, sampling,
                                  submission)
from labelscope.session import ensure_checkpoint_dir, stage_table
from labelscope.sources.io import (read_csv, read_history, write_csv, write_history, write_json,
                                   write_table, write_text)

REFERENCE_LABELS = list(range(len(LABEL_NAMES)))


# ---------------------------------------------------------------- T9

def profile_run(spark: SparkSession, train: DataFrame, out_dir: str,
                validation: DataFrame | None = None, label_col: str = "label",
                text_col: str = "code", labels: Sequence[int] = REFERENCE_LABELS,
                names: Sequence[str] | None = None, top_k: int = 20) -> dict[str, DataFrame]:
    """Profile tables (A1-A8, S-4, T9): class distribution with names, the
    summary row (size, classes, imbalance, distinct languages and generators,
    lengths), language counts, the top generators with the remainder count and
    the length statistics; for a validation split its distribution. Tables
    bounded by the classes or ``top_k`` are written as one file each."""
    # the text is read once: a narrow projection with its length is staged
    # and every table below derives from it
    meta = [c for c in ("language", "generator") if c in train.columns]
    narrow = stage_table(train.select(label_col, *meta,
                                      F.length(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
                                      .alias("_length")), "profile")
    out = {
        "distribution": profile.label_distribution(spark, narrow, label_col, labels, names),
        "summary": profile.corpus_profile(narrow, label_col, length_col="_length"),
        "length": profile.length_describe(narrow, length_col="_length"),
    }
    if "language" in meta:
        out["languages"] = profile.value_counts(narrow, "language")
    if "generator" in meta:
        out["generators_top"] = profile.top_values(narrow, "generator", top_k)
    if validation is not None:
        out["validation_distribution"] = profile.label_distribution(
            spark, validation, label_col, labels, names)
    write_text(profile.distribution_lines(out["distribution"]), f"{out_dir}/distribution_lines",
               order_col="label", single_file=True)
    for name, df in out.items():
        write_csv(df, f"{out_dir}/{name}", single_file=name != "languages")
    return out


# ---------------------------------------------------------------- E1

def rebalance_run(spark: SparkSession, df: DataFrame, out_path: str, mode: str = "majority", *,
                  human_samples: int = 50000, oversample_minority: bool = False,
                  target_per_class: int | None = None, samples_per_class: int = 5000,
                  seed=42, id_cols=("id",), label_col: str = "label",
                  labels: Sequence[int] = REFERENCE_LABELS):
    """Balance ``df``, write it as Parquet and report on what was written.

    mode ``majority`` (R7), ``equal`` (R8) or ``capped`` (R9). Returns
    ``(written, report, audit)``; ``written`` reads the Parquet output."""
    kw = dict(seed=seed, id_cols=id_cols, label_col=label_col, labels=labels)
    if mode == "majority":
        out = sampling.balance_majority(spark, df, human_samples, oversample_minority,
                                        target_per_class, **kw)
    elif mode == "equal":
        out = sampling.balance_equal(spark, df, samples_per_class, **kw)
    elif mode == "capped":
        out = sampling.sample_by_class(spark, df, samples_per_class, **kw)
    else:
        raise ValueError(f"unknown balancing mode {mode!r}")
    write_table(out, out_path)
    written = spark.read.parquet(out_path)
    return (written, sampling.balance_report(df, written, label_col, labels),
            sampling.balance_audit(df, written, label_col))


# ---------------------------------------------------------------- E2

def train_run(spark: SparkSession, train: DataFrame, validation: DataFrame, model_dir: str,
              history_path: str, sample_train: int | None = None, id_col: str | None = None, **train_kw):
    """Train, save the best model and its history. ``sample_train`` trains on that
    many rows (R10, by seeded key of ``id_col``). Returns ``(model, history, best)``."""
    if sample_train is not None:
        if id_col is None:
            raise ValueError("sample_train needs id_col")
        train = sampling.sample_n(train, sample_train, id_cols=[id_col]).drop("sample_rank")
    if id_col is not None:
        train_kw["id_col"] = id_col
    fitted, history = model.train_classifier(spark, train, validation, **train_kw)
    model.save_model(fitted, model_dir)
    write_history(history, history_path)
    return fitted, history, hist.best_epoch(history)


def score_run(spark: SparkSession, model_dir: str, test: DataFrame, key: str, out_path: str,
              text_col: str = "code", language_col: str | None = None) -> DataFrame:
    """IO10 -> T2 -> T3: score a test table with a saved model and write the
    positional ``id,label`` CSV in ``key`` order."""
    ensure_checkpoint_dir(spark)
    pred = model.predict(model.load_model(model_dir), test, key, text_col, language_col=language_col)
    table = submission.predictions_table(stage_table(pred, "scored"), key)
    write_csv(table, out_path, order_by=["id"])
    return table


# ---------------------------------------------------------------- E3

def predict_run(scored: DataFrame, key: str, out_path: str, make_scorer=None,
                logits_col: str = "logits") -> DataFrame:
    """Score, number rows by ``key`` order, write ``id,label`` CSV sorted by id.

    The model runs once: its narrow output (key, prediction) is staged under
    the checkpoint folder before R4 numbering reads it in several passes."""
    pred = model.batch_score(scored, key, make_scorer, logits_col=logits_col)
    staged = stage_table(pred.select(key, "y_pred"), "predictions")
    table = submission.predictions_table(staged, key)
    write_csv(table, out_path, order_by=["id"])
    return table


def submission_run(spark: SparkSession, test: DataFrame, predictions_path: str, out_path: str,
                   order_col: str) -> DataFrame:
    """T4: replace positional prediction ids by the test table's IDs; write ``ID,label``."""
    preds = read_csv(spark, predictions_path, schema="id BIGINT, label INT")
    sub = submission.submission_table(test, preds, order_col)
    write_csv(sub, out_path, order_by=["ID"])
    return sub


def validate_submission(spark: SparkSession, path: str,
                        valid_labels: Sequence[int] = REFERENCE_LABELS):
    """V1-V7 on a CSV read with every column as text. Returns
    ``(checks, first_failure, summary)``; ``summary`` is None when V1 fails."""
    ensure_checkpoint_dir(spark)
    raw = read_csv(spark, path)
    # six rows, checkpointed: the checks and the first failure share one pass
    checks = submission.submission_checks(spark, raw, valid_labels).checkpoint()
    summary = None
    if "id" in raw.columns and "label" in raw.columns:
        summary = submission.submission_summary(raw.select(F.col("label").try_cast("int").alias("label")))
    return checks, submission.first_failure(checks), summary


# ---------------------------------------------------------------- T12

def history_run(spark: SparkSession, path: str, metric: str = "val_f1"):
    """Read a history file (IO3) and return ``(series, events, best)``: the
    curve table with the ``val_loss`` default and plot flag (P12, P13), the
    epochs that would have saved a checkpoint (W-1) and the best epoch (W-2)."""
    h = read_history(spark, path)
    return hist.history_series(h), hist.checkpoint_events(h, metric), hist.best_epoch(h, metric)


# ---------------------------------------------------------------- T11

def compare_run(spark: SparkSession, path_a: str, path_b: str, key: str = "id",
                label_col: str = "label"):
    """Compare two prediction files (``id,label`` CSVs): ``(agreement, differences)``.
    The files must cover the same ids (S22), else a ValueError is raised.
    One full outer join is staged (id and both labels); the check, the
    agreement row and the differing rows all read it."""
    schema = f"{key} BIGINT, {label_col} INT"
    a, b = read_csv(spark, path_a, schema=schema), read_csv(spark, path_b, schema=schema)
    full = stage_table(groups.align_full(b, a.withColumnRenamed(label_col, "label_a"), key,
                                         pred_col=label_col, out="label_b"), "compare")
    both = groups.matched(full, True, key)
    same = F.coalesce(F.col("label_a") == F.col("label_b"), F.lit(False))  # a missing label agrees with nothing
    agreement = groups.agreement_row(both, same)
    return agreement, both.where(~same).select(key, "label_a", "label_b")


# ---------------------------------------------------------------- T8

def evaluation_run(spark: SparkSession, predictions: DataFrame, truth: DataFrame, key: str,
                   out_dir: str, labels: Sequence[int] = REFERENCE_LABELS,
                   names: Sequence[str] | None = None, pred_col: str = "label",
                   true_col: str = "label", group_cols: Sequence[str] = ("language", "generator"),
                   check: bool = True) -> dict[str, DataFrame]:
    """Full evaluation of one prediction set; writes every output under ``out_dir``
    and returns the DataFrames by output name."""
    ensure_checkpoint_dir(spark)
    if names is None:
        names = [LABEL_NAMES[i] if 0 <= i < len(LABEL_NAMES) else str(i) for i in labels]
    gcols = [g for g in group_cols if g in truth.columns]
    t = truth.select(key, F.col(true_col).cast("int").alias("y_true"), *gcols)
    p = predictions.select(key, F.col(pred_col).cast("int").alias("label"))
    # one join: persisted, checked for unmatched rows, then filtered to matches
    full = groups.align_full(p, t, key, pred_col="label", out="y_pred").persist(
        StorageLevel.MEMORY_AND_DISK)
    try:
        joined = groups.with_correct(groups.matched(full, check, key))
    except ValueError:
        full.unpersist()
        raise
    # <= K^2 rows; checkpointed so every metric below starts from a stored table
    pairs = metrics.pair_counts(joined).checkpoint()
    report = metrics.classification_report(spark, pairs, labels, names)
    out = {
        "classification_report": report,
        "metrics": metrics.metrics_record(pairs),
        "confusion_matrix": metrics.confusion_wide(spark, pairs, labels),
        "confusion_normalized": metrics.confusion_normalized(spark, pairs, labels),
        "per_class_f1": metrics.f1_series(spark, pairs, labels, names),
        "distribution": metrics.dense_distribution(spark, pairs, labels),
    }
    for g in gcols:
        out[f"{g}_stats"] = groups.accuracy_by_group(joined, g).orderBy(g)
        out[f"{g}_ranking"] = groups.accuracy_ranking(joined, g)
    write_text(metrics.report_text(report), f"{out_dir}/classification_report",
               order_col="row_order", single_file=True)
    write_json(out["metrics"], f"{out_dir}/metrics", single_file=True)
    for name, order in (("confusion_matrix", ["y_true"]), ("confusion_normalized", ["y_true", "y_pred"]),
                        ("per_class_f1", ["label"]), ("distribution", ["label"])):
        write_csv(out[name], f"{out_dir}/{name}", order_by=order, single_file=True)
    for g in gcols:
        write_csv(out[f"{g}_stats"], f"{out_dir}/{g}_stats")
        write_csv(out[f"{g}_ranking"], f"{out_dir}/{g}_ranking")
    full.unpersist()
    return out
