"""Submission validation: the good table passes, each bad variant fails the
check the reference would stop at."""

import pytest

from labelscope.operators import submission
from labelscope.sources import io


def _checks(spark, rows, cols=("id", "label")):
    df = spark.createDataFrame(rows, ", ".join(f"{c} STRING" for c in cols))
    res = submission.submission_checks(spark, df)
    first = submission.first_failure(res).collect()
    return {r["check"]: r["passed"] for r in res.collect()}, (first[0]["check"] if first else None)


GOOD = [("0", "3"), ("1", "4"), ("2", "0"), ("3", "10")]


def test_good(spark):
    checks, first = _checks(spark, GOOD)
    assert all(checks.values()) and first is None


@pytest.mark.parametrize("rows,cols,expect", [
    (GOOD, ("ID", "label"), "columns"),
    (GOOD + [("x1", "2")], ("id", "label"), "id_integer"),
    (GOOD + [("9", None)], ("id", "label"), "label_integer"),
    (GOOD + [("9", "11")], ("id", "label"), "label_range"),
    (GOOD + [("1", "2")], ("id", "label"), "unique_id"),
    ([(a, b, None) for a, b in GOOD], ("id", "label", "extra"), "no_missing"),
])
def test_bad_variants(spark, rows, cols, expect):
    _, first = _checks(spark, rows, cols)
    assert first == expect


def test_invalid_labels_and_duplicates(spark):
    df = spark.createDataFrame([(1, 3), (2, 11), (2, 12), (3, 11)], "id INT, label INT")
    assert sorted(r[0] for r in submission.invalid_labels(spark, df).collect()) == [11, 12]
    assert [(r["id"], r["n"]) for r in submission.duplicate_ids(df).collect()] == [(2, 2)]


def test_submission_join_by_position(spark):
    """Row 0 of the test table gets prediction 0, whatever the IDs' order."""
    test = spark.createDataFrame([(0, 105), (1, 101), (2, 103)], "pos INT, ID BIGINT")
    preds = spark.createDataFrame([(0, 7), (1, 8), (2, 9)], "id BIGINT, label INT")
    out = sorted(tuple(r) for r in submission.submission_table(test, preds, "pos").collect())
    assert out == [(101, 8), (103, 9), (105, 7)]
    for bad, text in [(preds.where("id < 2"), "without a prediction"), (preds.unionByName(preds.limit(1)), "repeated"),
                      (preds.unionByName(spark.createDataFrame([(5, 1)], "id BIGINT, label INT")), "without a test row")]:
        with pytest.raises(Exception, match=text):
            submission.submission_table(test, bad, "pos").collect()


def test_noncanonical_ids_are_duplicates(spark):
    rows, first = _checks(spark, [("1", "1"), ("01", "2"), ("+1", "3"), ("2", "4")], ("id", "label"))
    assert first == "unique_id"


def test_csv_columns_by_name(spark, tmp_path):
    path = str(tmp_path / "swapped")
    spark.createDataFrame([("3", "10"), ("4", "11")], "label STRING, id STRING").coalesce(1).write.option("header", True).csv(path)
    got = io.read_csv(spark, path, schema="id BIGINT, label INT")
    assert got.columns == ["id", "label"] and sorted(tuple(r) for r in got.collect()) == [(10, 3), (11, 4)]
    with pytest.raises(ValueError, match="no column"):
        io.read_csv(spark, path, schema="id BIGINT, other INT")
    spark.createDataFrame([("x", "10")], "label STRING, id STRING").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    with pytest.raises(Exception, match="is not int"):
        io.read_csv(spark, path, schema="id BIGINT, label INT").collect()


def test_resolve_id_prefers_ID(spark):
    df = spark.createDataFrame([(5, 1, "a")], "ID BIGINT, id BIGINT, code STRING")
    assert submission.resolve_id(df).first()["ID"] == 5
    with pytest.raises(ValueError):
        submission.resolve_id(df.drop("ID", "id"))


def test_csv_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 11) for i in range(50)], "id BIGINT, label INT")
    path = str(tmp_path / "pred")
    io.write_csv(df, path, order_by=["id"])
    back = io.read_csv(spark, path, columns=["id", "label"])
    res = submission.submission_checks(spark, back)
    assert all(r["passed"] for r in res.collect())


def test_single_file_csv_keeps_sort_order(spark, tmp_path):
    import glob

    from pyspark.sql import functions as F

    df = spark.range(50_000).select(((F.col("id") * 7919) % 50_000).alias("id")).repartition(13)
    io.write_csv(df, str(tmp_path / "o"), order_by=["id"], single_file=True)
    files = glob.glob(str(tmp_path / "o" / "part-*.csv"))
    assert len(files) == 1
    lines = open(files[0]).read().splitlines()
    assert lines[0] == "id" and [int(x) for x in lines[1:]] == list(range(50_000))
