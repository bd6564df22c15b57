"""Property tests: metrics against a plain computation on random prediction
sets; exact sizes, subset and no duplicates for seeded sampling."""

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from labelscope.operators import metrics, sampling

FAST = settings(max_examples=12, deadline=None,
                suppress_health_check=[HealthCheck.function_scoped_fixture])

pairs_st = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=1, max_size=60)


def _plain(pairs, labels):
    sup = Counter(t for t, _ in pairs)
    pred = Counter(p for _, p in pairs)
    tp = Counter(t for t, p in pairs if t == p)
    out = {}
    for k in labels:
        prec = tp[k] / pred[k] if pred[k] else 0.0
        rec = tp[k] / sup[k] if sup[k] else 0.0
        f1 = 2 * tp[k] / (sup[k] + pred[k]) if sup[k] + pred[k] else 0.0
        out[k] = (prec, rec, f1, sup[k])
    present = sorted(set(sup) | set(pred))
    macro = sum(out[k][2] for k in present) / len(present)
    acc = sum(tp.values()) / len(pairs)
    return out, macro, acc


@FAST
@given(pairs_st)
def test_metrics_match_plain_computation(spark, pairs):
    labels = list(range(5))
    df = spark.createDataFrame(pairs, "y_true INT, y_pred INT")
    pc = metrics.pair_counts(df)
    want, macro, acc = _plain(pairs, labels)
    got = {r["label"]: (r["precision"], r["recall"], r["f1"], r["support"])
           for r in metrics.per_class(spark, pc, labels).collect()}
    for k in labels:
        assert all(abs(a - b) < 1e-12 for a, b in zip(got[k], want[k]))
    rec = metrics.metrics_record(pc).first()
    assert abs(rec["macro_f1"] - macro) < 1e-12 and abs(rec["accuracy"] - acc) < 1e-12
    cm = metrics.confusion_matrix(spark, pc, labels).collect()
    assert sum(r["n"] for r in cm) == len(pairs) and len(cm) == 25


@FAST
@given(st.lists(st.integers(0, 3), min_size=1, max_size=300), st.integers(1, 40),
       st.integers(0, 10_000))
def test_sampling_exact_subset_unique(spark, labels, n, seed):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(labels)], "id BIGINT, label INT")
    out = sampling.sample_by_class(spark, df, n, seed=seed, labels=[0, 1, 2, 3]).collect()
    have = Counter(labels)
    got = Counter(r["label"] for r in out)
    assert all(got[c] == min(n, have[c]) for c in range(4))
    ids = [r["id"] for r in out]
    assert len(ids) == len(set(ids)) and all(labels[i] == r["label"] for i, r in zip(ids, out))
    assert sorted(r["row_id"] for r in out) == list(range(len(out)))


@FAST
@given(st.lists(st.integers(0, 2), min_size=1, max_size=200), st.integers(1, 9),
       st.sampled_from([1, 2, 5]), st.integers(0, 1000))
def test_bucketed_rank_equals_row_number(spark, labels, parts, digits, seed):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from labelscope.functions.hashing import seeded_key
    from labelscope.operators import ranking

    df = spark.createDataFrame([(i, c) for i, c in enumerate(labels)], "id BIGINT, label INT")
    keyed = df.withColumn("_key", seeded_key(seed, "id"))
    want = {r["id"]: r["r"] for r in keyed.select(
        "id", F.row_number().over(Window.partitionBy("label").orderBy("_key", "id")).alias("r")).collect()}
    got = ranking.bucketed_rank(keyed.repartition(parts), "_key", ["id"], ["label"], digits=digits,
                                domain_size=3, rank_col="r")
    assert {r["id"]: r["r"] for r in got.collect()} == want
    ids = ranking.row_ids(df.repartition(parts), "id", out="rid").collect()
    assert sorted((r["id"], r["rid"]) for r in ids) == [(i, i) for i in range(len(labels))]
