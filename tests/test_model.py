"""Training (T5, T7), scoring (T2, T6) and model save / load (IO10)."""

from conftest import SF_SMALL
from pyspark.sql import functions as F

from labelscope.operators import metrics, model
from labelscope.plans import roles


def test_train_history_predict_and_reload(spark, tmp_path):
    c = roles.corpus(spark, SF_SMALL)
    train = c.where(F.col("doc_id") % 5 != 0)
    val = c.where(F.col("doc_id") % 5 == 0)
    m, hist = model.train_classifier(spark, train, val, reg_params=(0.0, 0.1), max_iter=10,
                                     num_features=1 << 12)
    h = hist.orderBy("epoch").collect()
    assert [r["epoch"] for r in h] == [1, 2] and all(0.0 <= r["val_f1"] <= 1.0 for r in h)
    pred = model.predict(m, c, "doc_id")
    assert pred.count() == c.count()
    assert {r["y_pred"] for r in pred.select("y_pred").distinct().collect()} <= {0, 1, 2, 3}
    path = str(tmp_path / "model")
    model.save_model(m, path)
    again = model.predict(model.load_model(path), c, "doc_id")
    diff = pred.join(again.withColumnRenamed("y_pred", "y2"), "doc_id").where("y_pred <> y2")
    assert diff.count() == 0


def test_batch_score_matches_sql_argmax(spark):
    s = roles.scores(spark, SF_SMALL)
    scored = model.batch_score(s, "vec_id", keep=["y_true"], out="y_mip")
    j = scored.join(s.select("vec_id", "y_pred"), "vec_id")
    assert j.count() == s.count() and j.where("y_mip <> y_pred").count() == 0
    rec = metrics.metrics_record(metrics.pair_counts(scored.withColumnRenamed("y_mip", "y_pred"))).first()
    assert 0.0 <= rec["accuracy"] <= 1.0


def test_train_run_writes_model_and_history(spark, tmp_path):
    from labelscope.plans import runs

    c = roles.corpus(spark, SF_SMALL)
    m, hist, best = runs.train_run(spark, c, c, str(tmp_path / "m"), str(tmp_path / "h"),
                                   reg_params=(0.0, 0.5), max_iter=5, num_features=1 << 10)
    from labelscope.sources.io import read_history

    back = read_history(spark, str(tmp_path / "h"))
    assert back.count() == 2 and set(back.columns) == {"epoch", "reg_param", "train_loss", "train_f1", "val_f1"}
    from labelscope.operators.history import history_series

    series = history_series(back).collect()  # the history flow reads what training wrote
    assert len(series) == 2 and all(r["train_loss"] > 0 for r in series)
    b = best.collect()
    assert len(b) == 1 and b[0]["val_f1"] == max(r["val_f1"] for r in hist.collect())
    assert model.predict(model.load_model(str(tmp_path / "m")), c, "doc_id").count() == c.count()
    scored = runs.score_run(spark, str(tmp_path / "m"), c, "doc_id", str(tmp_path / "p"))
    rows = {r["id"]: r["label"] for r in scored.collect()}
    expect = [r["y_pred"] for r in model.predict(m, c, "doc_id").orderBy("doc_id").collect()]
    assert [rows[i] for i in range(len(expect))] == expect
    small, _, _ = runs.train_run(spark, c, c, str(tmp_path / "m2"), str(tmp_path / "h2"), sample_train=60, id_col="doc_id",
                                 reg_params=(0.1,), max_iter=3, num_features=1 << 8)
    assert model.predict(small, c, "doc_id").count() == c.count()


def test_metadata_prefix_on_both_sides(spark):
    c = roles.corpus(spark, SF_SMALL)
    m, _ = model.train_classifier(spark, c, c, reg_params=(0.0,), max_iter=5, num_features=1 << 10,
                                  language_col="language")
    p = model.predict(m, c, "doc_id", language_col="language")
    assert p.count() == c.count()
    # the prefix reaches the model's input on the scoring side too
    t = c.select(model._model_text(c, "code", "language")).first()["_text"]
    assert t.startswith("# Language: ") and "\n" in t
    j = p.join(c.select("doc_id", "label"), "doc_id")
    assert j.where("y_pred = label").count() >= 0.9 * c.count()


def test_weighted_sampler_training(spark):
    c = roles.corpus(spark, SF_SMALL)
    m, hist = model.train_classifier(spark, c, c, reg_params=(0.0,), max_iter=5,
                                     num_features=1 << 10, sampler="weighted", id_col="doc_id")
    h = hist.first()
    assert 0.0 <= h["train_f1"] <= 1.0 and 0.0 <= h["val_f1"] <= 1.0
    assert model.predict(m, c, "doc_id").count() == c.count()


def test_training_rows_are_not_dealt_out_by_class(spark, monkeypatch):
    """One class has nearly all rows; the cached vectors must not lie in its task."""
    import pyspark.ml.feature as feature

    rows = [(i, f"word{i % 7} line {i}", 0 if i % 20 else 1 + i // 20 % 3) for i in range(800)]
    c = spark.createDataFrame(rows, "id long, code string, label int").repartition(8)
    seen, fit = [], feature.IDF.fit

    def look(self, df, *rest):
        seen.extend(df.rdd.glom().map(len).collect())
        return fit(self, df, *rest)

    monkeypatch.setattr(feature.IDF, "fit", look)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        model.train_classifier(spark, c, c, reg_params=(0.1,), max_iter=2, num_features=1 << 8)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert sum(seen) == 800 and max(seen) <= 200, seen
