"""Registered queries: one per operator family, each over whole driver tables.

``QUERIES[name](spark, sf_dir) -> DataFrame``. Floating outputs are rounded
to 6 digits (and ints cast to fixed widths) so results hash identically to
the DuckDB oracle in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from labelscope.functions.hashing import hex_prefix_int
from labelscope.functions.labels import LABEL_NAMES
from labelscope.functions.text import metadata_prefix
from labelscope.operators import (encode, groups, history as hist, losses, metrics, model,
                                  profile, ranking, sampling, submission, weights)
from labelscope.plans import extended, roles

SEED = 42
K_FIXED = list(range(11))  # the reference's 11 classes (M5, A5)
VOCAB_SIZE = 5000
MAX_LENGTH = 512
BATCH_SIZE = 16
GAMMA = 2.0
# sampling parameters on the skewed role
HUMAN_SAMPLES = 5000
# shares of the orders, so that the minority classes (a 25th each) are
# bootstrapped at every size
TARGET_SHARE = 12
PER_CLASS_SHARE = 8
DRAWS_SHARE = 75
EXACT_N = 5000


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _pairs(spark, d):
    return metrics.pair_counts(roles.scores(spark, d))


# ------------------------------------------------------------------ metrics

def q_argmax_predictions(spark, d):
    return roles.scores(spark, d).select("vec_id", "y_true", "y_pred")


def q_confusion_matrix(spark, d):
    return metrics.confusion_matrix(spark, _pairs(spark, d), roles.SCORE_CLASSES)


def q_confusion_normalized(spark, d):
    cm = metrics.confusion_normalized(spark, _pairs(spark, d), roles.SCORE_CLASSES)
    return cm.select("y_true", "y_pred", "n", r6("share").alias("share"))


def q_per_class_prf(spark, d):
    pc = metrics.per_class(spark, _pairs(spark, d), roles.SCORE_CLASSES)
    return pc.select("label", r6("precision").alias("precision"), r6("recall").alias("recall"),
                     r6("f1").alias("f1"), "support", "predicted", "tp")


def q_macro_f1(spark, d):
    return metrics.macro_f1(_pairs(spark, d)).select(r6("macro_f1").alias("macro_f1"))


def q_macro_f1_fixed(spark, d):
    return metrics.macro_f1_fixed(spark, _pairs(spark, d), K_FIXED).select(
        r6("macro_f1").alias("macro_f1"))


def q_accuracy(spark, d):
    return metrics.accuracy(_pairs(spark, d)).select(r6("accuracy").alias("accuracy"))


def q_metrics_record(spark, d):
    return metrics.metrics_record(_pairs(spark, d)).select(
        r6("macro_f1").alias("macro_f1"), r6("accuracy").alias("accuracy"))


def q_classification_report(spark, d):
    labels = roles.SCORE_CLASSES
    rep = metrics.classification_report(spark, _pairs(spark, d), labels,
                                        [LABEL_NAMES[i] for i in labels])
    return rep.select(F.col("row_order").cast("int").alias("row_order"), "name",
                      r6("precision").alias("precision"), r6("recall").alias("recall"),
                      r6("f1_score").alias("f1_score"), "support")


def q_f1_series(spark, d):
    labels = roles.SCORE_CLASSES
    s = metrics.f1_series(spark, _pairs(spark, d), labels, [LABEL_NAMES[i] for i in labels])
    return s.select("label", "name", r6("f1").alias("f1"), "above_half", r6("macro_f1").alias("macro_f1"))


def q_dense_distribution(spark, d):
    return metrics.dense_distribution(spark, _pairs(spark, d), K_FIXED)


# ------------------------------------------------------------------ profile

def _corpus_dim():
    return list(range(len(roles.CORPUS_LANGS))), roles.CORPUS_LANGS


def q_label_distribution(spark, d):
    labels, names = _corpus_dim()
    dist = profile.label_distribution(spark, roles.corpus(spark, d, with_text=False), "label",
                                      labels, names)
    return dist.select("label", "name", "count", r6("pct").alias("pct"))


def q_imbalance_ratio(spark, d):
    return profile.imbalance_ratio(roles.corpus(spark, d, with_text=False)).select(
        r6("imbalance_ratio").alias("imbalance_ratio"))


def q_language_counts(spark, d):
    return profile.value_counts(roles.corpus(spark, d, with_text=False), "language")


def q_generator_top20(spark, d):
    return profile.top_values(roles.corpus(spark, d, with_text=False), "generator", 20).select(
        "generator", "count", F.col("rank").cast("int").alias("rank"), "remaining")


def q_customer_top20(spark, d):
    # more distinct values than 20: the cut and the remainder both show
    o = roles.table(spark, d, "orders", ["o_custkey"])
    return profile.top_values(o, "o_custkey", 20).select(
        "o_custkey", "count", F.col("rank").cast("int").alias("rank"), "remaining")


def q_length_describe(spark, d):
    ds = profile.length_describe(roles.corpus(spark, d), "code")
    return ds.select("count", *[r6(c).alias(c) for c in
                                ("mean", "std", "min", "p25", "p50", "p75", "max")])


def q_corpus_profile(spark, d):
    p = profile.corpus_profile(roles.corpus(spark, d))
    return p.select("rows", r6("mean_length").alias("mean_length"), "min_length", "max_length",
                    "n_languages", "n_generators", "n_classes",
                    r6("imbalance_ratio").alias("imbalance_ratio"))


# ------------------------------------------------------------------ grouped evaluation

def _judged(spark, d):
    return groups.with_correct(roles.judged(spark, d))


def q_accuracy_by_language(spark, d):
    return groups.accuracy_by_group(_judged(spark, d), "language")


def q_accuracy_by_generator(spark, d):
    return groups.accuracy_by_group(_judged(spark, d), "generator")


def q_accuracy_ranking(spark, d):
    return groups.accuracy_ranking(_judged(spark, d), "generator").select(
        "generator", r6("accuracy").alias("accuracy"))


def _two_sets(spark, d):
    a = roles.scores(spark, d).select(F.col("vec_id").alias("id"), F.col("y_pred").alias("label"))
    b = roles.scores_b(spark, d).select(F.col("vec_id").alias("id"), F.col("y_pred").alias("label"))
    return a, b


def q_prediction_agreement(spark, d):
    a, b = _two_sets(spark, d)
    return groups.agreement(a, b).select("n", r6("agreement").alias("agreement"), "differences",
                                         r6("difference_pct").alias("difference_pct"))


def q_agreement_with_nulls(spark, d):
    # labels are missing where the id is divisible by 7 (one side) or 11 (both)
    a, b = _two_sets(spark, d)
    label = F.col("label")
    a = a.select("id", F.when((F.col("id") % 7 != 0) & (F.col("id") % 11 != 0), label).alias("label"))
    b = b.select("id", F.when(F.col("id") % 11 != 0, label).alias("label"))
    return groups.agreement(a, b, check=True).select("n", r6("agreement").alias("agreement"), "differences",
                                                     r6("difference_pct").alias("difference_pct"))


def q_disagreements(spark, d):
    a, b = _two_sets(spark, d)
    return groups.differences(a, b)


# ------------------------------------------------------------------ weights and losses

def q_class_weights_inverse(spark, d):
    w = weights.class_weights(roles.corpus(spark, d, with_text=False), "inverse")
    return w.select("label", "count", r6("weight").alias("weight"))


def q_class_weights_effective(spark, d):
    w = weights.class_weights(roles.corpus(spark, d, with_text=False), "effective")
    return w.select("label", "count", r6("weight").alias("weight"))


def q_row_weights(spark, d):
    c = roles.corpus(spark, d, with_text=False)
    w = weights.class_weights(c, "inverse")
    return weights.attach_weights(c.select("doc_id", "label"), w,
                                  max_classes=len(roles.CORPUS_LANGS)).select(
        "doc_id", "label", r6("weight").alias("weight"))


def q_cross_entropy(spark, d):
    return losses.cross_entropy(roles.scores(spark, d)).select(
        r6("cross_entropy").alias("cross_entropy"))


def _focal(spark, d, reduction, pt="weighted"):
    s = roles.scores(spark, d)
    alpha = weights.class_weights(s.select(F.col("y_true").alias("label")), "inverse")
    return losses.focal_loss(s, alpha=alpha, gamma=GAMMA, reduction=reduction, pt=pt,
                             max_classes=len(roles.SCORE_CLASSES))


def q_focal_loss_rows(spark, d):
    return _focal(spark, d, "none").select("vec_id", r6("ce").alias("ce"), r6("focal").alias("focal"))


def q_focal_loss_mean(spark, d):
    return _focal(spark, d, "mean").select(r6("focal_loss").alias("focal_loss"))


def q_batch_loss_mean(spark, d):
    s = losses.cross_entropy_rows(roles.scores(spark, d))
    s = ranking.row_ids(s, "vec_id")
    return losses.batch_mean_of_means(s, "ce", "row_id", BATCH_SIZE).select(
        r6("mean_batch_loss").alias("mean_batch_loss"), "n_batches")


# ------------------------------------------------------------------ sampling and balancing

def _skewed(spark, d):
    return roles.skewed(spark, d)


def _share(spark, d, k):
    return roles.table(spark, d, "orders", ["o_orderkey"]).count() // k


_ID = dict(id_cols=["o_orderkey"], seed=SEED, labels=roles.SKEWED_CLASSES)


def q_sample_exact_n(spark, d):
    return sampling.sample_n(_skewed(spark, d), EXACT_N, id_cols=["o_orderkey"], seed=SEED).select(
        "o_orderkey", "sample_rank")


def q_sample_with_replacement(spark, d):
    return sampling.sample_with_replacement(spark, _skewed(spark, d), _share(spark, d, DRAWS_SHARE), **_ID).select(
        "label", "draw", "o_orderkey")


def q_shuffle_row_id(spark, d):
    return ranking.shuffled_row_id(_skewed(spark, d), SEED, ["o_orderkey"]).select("o_orderkey", "row_id")


def _balanced(spark, d, shuffle=True):
    return sampling.balance_majority(spark, _skewed(spark, d), HUMAN_SAMPLES, shuffle=shuffle, **_ID)


def q_balance_majority(spark, d):
    return _balanced(spark, d).select("o_orderkey", "label", "sample_key", "row_id")


def q_balance_oversample(spark, d):
    return sampling.balance_majority(spark, _skewed(spark, d), HUMAN_SAMPLES, True, _share(spark, d, TARGET_SHARE),
                                     **_ID).select("o_orderkey", "label", "sample_key", "row_id")


def q_balance_ultra(spark, d):
    return sampling.balance_equal(spark, _skewed(spark, d), _share(spark, d, PER_CLASS_SHARE), **_ID).select(
        "o_orderkey", "label", "sample_key", "row_id")


def q_sample_by_class(spark, d):
    return sampling.sample_by_class(spark, _skewed(spark, d), _share(spark, d, PER_CLASS_SHARE), **_ID).select(
        "o_orderkey", "label", "sample_key", "row_id")


def q_weighted_sampler(spark, d):
    return sampling.weighted_sample(spark, _skewed(spark, d), **_ID).select("draw_id", "label", "o_orderkey")


def q_balance_report(spark, d):
    # the report needs counts only: no R3 row ids
    rep = sampling.balance_report(_skewed(spark, d), _balanced(spark, d, shuffle=False),
                                  labels=roles.SKEWED_CLASSES)
    return rep.select("rows_before", "rows_after", r6("reduction_pct").alias("reduction_pct"),
                      r6("imbalance_before").alias("imbalance_before"),
                      r6("imbalance_after").alias("imbalance_after"), "rows_dropped")


def q_balance_audit(spark, d):
    return sampling.balance_audit(_skewed(spark, d), _balanced(spark, d, shuffle=False))


# ------------------------------------------------------------------ submission tables

def _predictions(spark, d):
    return submission.predictions_table(roles.scores(spark, d), "vec_id")


def q_predictions_table(spark, d):
    return _predictions(spark, d)


def q_submission_checks(spark, d):
    p = _predictions(spark, d).select(F.col("id").cast("string").alias("id"),
                                      F.col("label").cast("string").alias("label"))
    return submission.submission_checks(spark, p)


def q_invalid_labels(spark, d):
    # a 64-way head's predictions checked against the 11-class contract
    e = roles.table(spark, d, "embeddings", ["vec_id", "embedding"])
    wide = e.select(F.col("vec_id").alias("id"), F.array_position(
        F.col("embedding"), F.array_max("embedding")).cast("int") - 1).toDF("id", "label")
    return submission.invalid_labels(spark, wide)


def q_duplicate_ids(spark, d):
    li = roles.table(spark, d, "lineitem", ["l_orderkey"])
    return submission.duplicate_ids(li.select(F.col("l_orderkey").alias("id")), "id")


def q_submission_join(spark, d):
    test = roles.table(spark, d, "embeddings", ["vec_id"]).select(F.col("vec_id").alias("ID"))
    return submission.submission_table(test, _predictions(spark, d), "ID")


def q_submission_by_position(spark, d):
    # IDs run against the position: the last order comes first
    test = roles.table(spark, d, "orders", ["o_orderkey"]).select(
        F.col("o_orderkey").alias("ID"), (-F.col("o_orderkey")).alias("pos"))
    scored = roles.table(spark, d, "orders", ["o_orderkey", "o_custkey"]).select(
        (-F.col("o_orderkey")).alias("pos"), (F.col("o_custkey") % 11).alias("y_pred"))
    return submission.submission_table(test, submission.predictions_table(scored, "pos"), "pos")


def q_submission_checks_noncanonical(spark, d):
    # every integer id occurs as n, 0n and +n
    li = roles.table(spark, d, "lineitem", ["l_orderkey", "l_linenumber"])
    sign = F.element_at(F.array(F.lit(""), F.lit("0"), F.lit("+")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return submission.submission_checks(spark, li.select(
        F.concat(sign, F.col("l_orderkey").cast("string")).alias("id"), F.col("l_linenumber").cast("string").alias("label")))


# ------------------------------------------------------------------ history

def q_history_series(spark, d):
    h = hist.history_series(roles.history(spark, d))
    return h.select("epoch", *[r6(c).alias(c) for c in ("train_loss", "train_f1", "val_f1", "val_loss")],
                    "plot_val_loss")


def q_checkpoint_events(spark, d):
    e = hist.checkpoint_events(roles.history(spark, d))
    return e.select("epoch", r6("val_f1").alias("val_f1"))


def q_best_epoch(spark, d):
    b = hist.best_epoch(roles.history(spark, d))
    return b.select("epoch", r6("val_f1").alias("val_f1"))


# ------------------------------------------------------------------ text

def q_metadata_prefix(spark, d):
    c = roles.corpus(spark, d)
    return c.select("doc_id", metadata_prefix("code", "language").alias("text_with_meta"))


def q_vocabulary(spark, d):
    return encode.vocabulary(roles.corpus(spark, d), "code", VOCAB_SIZE)


def q_encode_fixed_length(spark, d):
    c = roles.corpus(spark, d)
    v = encode.vocabulary(c, "code", VOCAB_SIZE)
    return encode.encode(c, v, "doc_id", "code", MAX_LENGTH)


# ------------------------------------------------------------------ scoring and training

def q_batch_score(spark, d):
    return model.batch_score(roles.scores(spark, d), "vec_id", keep=["y_true"])


def q_train_classifier(spark, d):
    """Two candidates trained on four fifths of the documents (by id hash), the
    better one judged on the rest: held-out rows per class and in all, and
    whether the accuracy beats always guessing the largest class."""
    c = roles.corpus(spark, d)
    fold = hex_prefix_int(F.md5(F.concat(F.lit("fold:"), F.col("doc_id").cast("string"))), 8) % 5
    train, held = c.where(fold != 0), c.where(fold == 0)
    m, _ = model.train_classifier(spark, train, held)
    judged = model.predict(m, held, "doc_id", keep=["label"]).withColumnRenamed("label", "y_true")
    per = judged.groupBy(F.col("y_true").alias("label")).agg(
        F.count(F.lit(1)).alias("support"), F.count_if(F.col("y_true") == F.col("y_pred")).alias("right"),
        F.count_if(F.col("y_pred").between(0, len(roles.CORPUS_LANGS) - 1)).alias("in_domain"))
    every = Window.partitionBy()  # <= one row per class
    return per.select("label", "support", F.sum("support").over(every).alias("scored"),
                      (F.sum("in_domain").over(every) == F.sum("support").over(every)).alias("labels_in_domain"),
                      (F.sum("right").over(every) > F.max("support").over(every)).alias("beats_majority"))


# ------------------------------------------------------------------ coverage: weights, labels, tables

def q_class_weights_reciprocal(spark, d):
    w = weights.class_weights(roles.corpus(spark, d, with_text=False), "reciprocal")
    return w.select("label", "count", r6("weight").alias("weight"))


def q_class_weights_balanced(spark, d):
    # The "balanced" weights over the sorted distinct true labels of the scores role
    s = roles.scores(spark, d).select(F.col("y_true").alias("label"))
    w = weights.class_weights(s, "balanced")
    return w.select("label", "count", r6("weight").alias("weight"))


def q_weights_report(spark, d):
    r = weights.weights_report(roles.corpus(spark, d, with_text=False))
    return r.select("label", "count", r6("weight_inverse").alias("weight_inverse"),
                    r6("weight_effective").alias("weight_effective"))


def q_distinct_labels(spark, d):
    return profile.distinct_labels(roles.scores(spark, d).select(F.col("y_true").alias("label")))


def q_prediction_distribution(spark, d):
    # A22 + P4: the predicted labels' distribution with class names
    p = roles.scores(spark, d).select(F.col("y_pred").alias("label"))
    labels = roles.SCORE_CLASSES
    dist = profile.label_distribution(spark, p, "label", labels, [LABEL_NAMES[i] for i in labels])
    return dist.select("label", "name", "count", r6("pct").alias("pct"))


def q_confusion_wide(spark, d):
    return metrics.confusion_wide(spark, _pairs(spark, d), roles.SCORE_CLASSES)


def q_report_lines(spark, d):
    labels = roles.SCORE_CLASSES
    rep = metrics.classification_report(spark, _pairs(spark, d), labels,
                                        [LABEL_NAMES[i] for i in labels])
    return metrics.report_text(rep).select(F.col("row_order").cast("int").alias("row_order"), "value")


def q_submission_summary(spark, d):
    s = submission.submission_summary(roles.scores(spark, d).select(F.col("y_pred").alias("label")))
    return s.select("label", "count", r6("pct").alias("pct"), "total")


def q_submission_preview(spark, d):
    return submission.preview(q_submission_join(spark, d), "ID", 10)


def q_submission_first_failure(spark, d):
    # a submission built from lineitem: ids repeat and labels run past 10
    li = roles.table(spark, d, "lineitem", ["l_orderkey", "l_linenumber"])
    sub = li.select(F.col("l_orderkey").cast("string").alias("id"),
                    (F.col("l_linenumber") + 5).cast("string").alias("label"))
    return submission.first_failure(submission.submission_checks(spark, sub))


def q_batch_ids(spark, d):
    s = ranking.row_ids(roles.scores(spark, d).select("vec_id"), "vec_id")
    return ranking.batch_ids(s, "row_id", BATCH_SIZE).select("vec_id", "row_id", "batch")


def q_distribution_lines(spark, d):
    labels, names = _corpus_dim()
    dist = profile.label_distribution(spark, roles.corpus(spark, d, with_text=False), "label",
                                      labels, names)
    return profile.distribution_lines(dist)


def q_balance_summary_lines(spark, d):
    rep = sampling.balance_report(_skewed(spark, d), _balanced(spark, d, shuffle=False))
    return sampling.balance_summary_lines(rep)


def q_balance_audit_lines(spark, d):
    sk = _skewed(spark, d)
    out = sampling.balance_majority(spark, sk, HUMAN_SAMPLES, True, _share(spark, d, TARGET_SHARE), shuffle=False, **_ID)
    labels = roles.SKEWED_CLASSES
    return sampling.balance_audit_lines(spark, sampling.balance_audit(sk, out), labels,
                                        [LABEL_NAMES[i] for i in labels])


def q_focal_loss_sum(spark, d):
    return _focal(spark, d, "sum").select(r6("focal_loss").alias("focal_loss"))


def q_focal_loss_documented(spark, d):
    # S5 option: the documented pt = p (unweighted probability) with alpha-weighted CE
    return _focal(spark, d, "mean", pt="unweighted").select(r6("focal_loss").alias("focal_loss"))


QUERIES = {name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_")} | extended.QUERIES

FLAGSHIP = "per_class_prf"
