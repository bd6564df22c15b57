"""End-to-end flows: rebalance -> Parquet; score -> predictions -> submission ->
validation; full evaluation written to files."""

import glob
import json

import pytest

from conftest import SF_SMALL
from pyspark.sql import functions as F
from labelscope.functions.labels import LABEL_NAMES
from test_metrics import MACRO, REPORT, SUPPORT, WEIGHTED, golden_pairs

from labelscope.operators import groups, profile
from labelscope.plans import roles, runs


def test_rebalance_run_reports_written_table(spark, tmp_path):
    skewed = roles.skewed(spark, "/root/testdata/sf0.01")
    written, report, audit = runs.rebalance_run(
        spark, skewed, str(tmp_path / "balanced"), "majority", human_samples=1000,
        id_cols=["o_orderkey"], labels=roles.SKEWED_CLASSES)
    rep = report.first()
    assert rep["rows_after"] == written.count() == 1000 + skewed.where("label <> 0").count()
    assert rep["rows_before"] == skewed.count()
    assert sorted(r["row_id"] for r in written.select("row_id").collect()) == list(range(rep["rows_after"]))
    actions = {r["label"]: r["action"] for r in audit.collect()}
    assert actions == {0: "undersampled", 1: "kept", 2: "kept", 3: "kept"}


def test_predict_submit_validate(spark, tmp_path):
    scores = roles.scores(spark, SF_SMALL)
    pred_path, sub_path = str(tmp_path / "pred"), str(tmp_path / "sub")
    runs.predict_run(scores, "vec_id", pred_path)
    checks, first, summary = runs.validate_submission(spark, pred_path)
    assert all(r["passed"] for r in checks.collect()) and first.count() == 0
    n = scores.count()
    assert summary.agg(F.sum("count")).first()[0] == n
    # the test table's IDs replace the positional ids; labels keep their order
    test = scores.select(F.col("vec_id").alias("ID"))
    runs.submission_run(spark, test, pred_path, sub_path, order_col="ID")
    sub = spark.read.option("header", True).csv(sub_path)
    assert sub.columns == ["ID", "label"] and sub.count() == n
    got = {int(r["ID"]): int(r["label"]) for r in sub.collect()}
    want = {r["vec_id"]: r["y_pred"] for r in scores.collect()}
    assert got == want
    # a submission file with header ID fails its own check at the columns test
    _, first_sub, _ = runs.validate_submission(spark, sub_path)
    assert [r["check"] for r in first_sub.collect()] == ["columns"]


def test_evaluation_run_golden(spark, tmp_path):
    rows = [(i, t, p, ["C", "Java", "Python"][i % 3]) for i, (t, p) in enumerate(golden_pairs())]
    df = spark.createDataFrame(rows, "id BIGINT, y_true INT, y_pred INT, language STRING").repartition(4)
    out = runs.evaluation_run(spark, df.select("id", F.col("y_pred").alias("label")),
                              df.select("id", F.col("y_true").alias("label"), "language"),
                              "id", str(tmp_path / "eval"))
    files = glob.glob(str(tmp_path / "eval" / "metrics" / "*.json"))
    rec = json.loads(open(files[0]).read())
    assert abs(rec["macro_f1"] - 0.3501863512702263) < 1e-12 and abs(rec["accuracy"] - 0.677) < 1e-12
    lines = []
    for f in sorted(glob.glob(str(tmp_path / "eval" / "classification_report" / "part-*"))):
        lines += open(f).read().splitlines()
    # the published 17 lines: header, classes, summary, with blank lines between
    assert len(lines) == 17 and lines[1] == lines[13] == ""
    assert lines[0] == "              precision    recall  f1-score   support"
    for line, name, (p, r, f1), n in zip(lines[2:13], LABEL_NAMES, REPORT, SUPPORT):
        assert line == f"{name:>12}  {p:9.3f} {r:9.3f} {f1:9.3f} {n:9d}"
    assert lines[14] == f"{'accuracy':>12}  {'':9} {'':9} {0.677:9.3f} {1000:9d}"
    for line, name, row in zip(lines[15:], ("macro avg", "weighted avg"), (MACRO, WEIGHTED)):
        assert line == f"{name:>12}  {row[0]:9.3f} {row[1]:9.3f} {row[2]:9.3f} {1000:9d}"
    lang = {r["language"]: (r["accuracy"], r["count"]) for r in out["language_stats"].collect()}
    j = df.withColumn("correct", (F.col("y_true") == F.col("y_pred")).cast("int"))
    want = {r["language"]: (r["accuracy"], r["count"])
            for r in groups.accuracy_by_group(j, "language").collect()}
    assert lang == want and sum(c for _, c in lang.values()) == 1000
    cm = out["confusion_matrix"].collect()
    assert len(cm) == 11 and sum(sum(r[1:]) for r in cm) == 1000
    dist = {r["label"]: r["true_count"] for r in out["distribution"].collect()}
    assert dist == {r["label"]: r["count"] for r in profile.label_counts(
        df.select(F.col("y_true").alias("label"))).collect()}


def test_evaluation_run_raises_on_unmatched(spark, tmp_path):
    import pytest

    truth = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id BIGINT, label INT")
    pred = spark.createDataFrame([(1, 0), (2, 1), (4, 1)], "id BIGINT, label INT")
    with pytest.raises(ValueError, match="one to one"):
        runs.evaluation_run(spark, pred, truth, "id", str(tmp_path / "e"))
    out = groups.align(pred, truth, "id", check=False)
    assert sorted(r["id"] for r in out.collect()) == [1, 2]


def test_profile_run(spark, tmp_path):
    c = roles.corpus(spark, SF_SMALL)
    train, val = c.where("doc_id % 4 <> 0"), c.where("doc_id % 4 = 0")
    out = runs.profile_run(spark, train, str(tmp_path / "p"), val, labels=[0, 1, 2, 3],
                           names=roles.CORPUS_LANGS)
    n_train, n_val = train.count(), val.count()
    assert out["summary"].first()["rows"] == n_train
    from labelscope.operators import profile as prof

    assert out["summary"].first().asDict() == prof.corpus_profile(train).first().asDict()
    assert out["length"].first().asDict() == prof.length_describe(train).first().asDict()
    assert sum(r["count"] for r in out["distribution"].collect()) == n_train
    assert sum(r["count"] for r in out["validation_distribution"].collect()) == n_val
    top = out["generators_top"].collect()
    assert len(top) == min(20, train.select("generator").distinct().count())
    lines = glob.glob(str(tmp_path / "p" / "distribution_lines" / "part-*"))
    assert sum(len(open(f).read().splitlines()) for f in lines) == 4


def test_balancing_arithmetic_golden(spark, tmp_path):
    """SURVEY section 5, identity 4: 442,096 -> 50,000 for class 0, 57,904 kept,
    107,904 in total, 78.4 % reduction, imbalance 224.6 -> 25.4. The other
    classes' split is not published; any split with smallest class 1,968 fits."""
    # Published class-0 size and total of classes 1..10.
    sizes = [442_096] + [6_215] * 8 + [6_216, 1_968]
    assert sum(sizes) == 500_000 and sum(sizes[1:]) == 57_904
    # class of row id: a CASE over the cumulative class boundaries
    expr, acc = None, 0
    for c, n in enumerate(sizes):
        acc += n
        expr = F.when(F.col("id") < acc, F.lit(c)) if expr is None else expr.when(F.col("id") < acc, F.lit(c))
    train = spark.range(500_000).select("id", expr.cast("int").alias("label"))
    written, report, audit = runs.rebalance_run(spark, train, str(tmp_path / "b"), "majority",
                                                human_samples=50_000)
    rep = report.first()
    assert (rep["rows_before"], rep["rows_after"], rep["rows_dropped"]) == (500_000, 107_904, 0)
    assert round(rep["reduction_pct"], 1) == 78.4
    assert round(rep["imbalance_before"], 1) == 224.6 and round(rep["imbalance_after"], 1) == 25.4
    acts = {r["label"]: (r["n_before"], r["n_after"], r["action"]) for r in audit.collect()}
    assert acts[0] == (442_096, 50_000, "undersampled")
    assert all(acts[c][2] == "kept" for c in range(1, 11))


def test_compare_run(spark, tmp_path):
    from labelscope.sources import io

    s = roles.scores(spark, SF_SMALL)
    b = roles.scores_b(spark, SF_SMALL)
    pa, pb = str(tmp_path / "a"), str(tmp_path / "b")
    io.write_csv(s.select(F.col("vec_id").alias("id"), F.col("y_pred").alias("label")), pa, ["id"])
    io.write_csv(b.select(F.col("vec_id").alias("id"), F.col("y_pred").alias("label")), pb, ["id"])
    agree, diff = runs.compare_run(spark, pa, pb)
    r = agree.first()
    want = s.join(b.withColumnRenamed("y_pred", "yb"), "vec_id").where("y_pred <> yb").count()
    assert r["n"] == s.count() and r["differences"] == want == diff.count()
    import pytest

    pc = str(tmp_path / "c")
    io.write_csv(b.where("vec_id > 0").select(F.col("vec_id").alias("id"), F.col("y_pred").alias("label")),
                 pc, ["id"])
    with pytest.raises(ValueError, match="one to one"):
        runs.compare_run(spark, pa, pc)


def test_history_run(spark, tmp_path):
    import json as _json

    # An epoch history in the reference's JSON-array layout
    recs = [{"epoch": 1, "train_loss": 0.9, "train_f1": 0.3, "val_f1": 0.2},
            {"epoch": 2, "train_loss": 0.7, "train_f1": 0.4, "val_f1": 0.5},
            {"epoch": 3, "train_loss": 0.6, "train_f1": 0.5, "val_f1": 0.4},
            {"epoch": 4, "train_loss": 0.5, "train_f1": 0.6, "val_f1": 0.5}]
    p = tmp_path / "history.json"
    p.write_text(_json.dumps(recs, indent=2))
    series, events, best = runs.history_run(spark, str(p))
    assert [r["val_loss"] for r in series.orderBy("epoch").collect()] == [0.0] * 4
    assert series.first()["plot_val_loss"] is False
    assert [r["epoch"] for r in events.orderBy("epoch").collect()] == [1, 2]
    assert [(r["epoch"], r["val_f1"]) for r in best.collect()] == [(2, 0.5)]


def test_compared_files_count_missing_labels_as_different(spark, tmp_path):
    for name, labels in (("a", [1, None, 4]), ("b", [1, 2, 5])):
        rows = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "id bigint, label int")
        rows.write.option("header", True).csv(str(tmp_path / name))
    row, differing = runs.compare_run(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    r = row.first()
    assert (r["n"], r["differences"]) == (3, 2) and abs(r["agreement"] - 1 / 3) < 1e-12
    assert sorted((d["id"], d["label_a"], d["label_b"]) for d in differing.collect()) == [(1, None, 2), (2, 4, 5)]


def test_repeated_keys_do_not_align(spark):
    from labelscope.operators import groups

    once = spark.createDataFrame([(1, 0), (2, 1)], "id bigint, label int")
    twice = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "id bigint, label int")
    assert groups.align(once, once.withColumnRenamed("label", "y"), "id", check=True).count() == 2
    for pred, truth in ((once, twice), (twice, once), (twice, twice)):
        with pytest.raises(ValueError):
            groups.align(pred, truth.withColumnRenamed("label", "y"), "id", check=True)


def test_repeated_ids_are_not_sampled_or_numbered(spark):
    from labelscope.operators import ranking, sampling

    df = spark.createDataFrame([(i // 2, i) for i in range(10)], "id bigint, x int")
    with pytest.raises(Exception, match="not unique"):
        sampling.sample_n(df, 5).collect()
    with pytest.raises(Exception, match="not unique"):
        ranking.shuffled_row_id(df, 1, ["id"]).collect()
    ids = ranking.shuffled_row_id(df, 1, ["id", "x"])
    assert sorted(r["row_id"] for r in ids.collect()) == list(range(10))
