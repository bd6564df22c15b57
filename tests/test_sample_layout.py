"""Samples from a stored layout."""

import pytest
from pyspark.sql import functions as F

from labelscope.operators import sample_layout as L
from labelscope.operators import sampling


def table(spark, n):
    label = F.when(F.col("id") % 50 == 0, 2).when(F.col("id") % 10 == 0, 1).when(F.col("id") % 7 == 0, None).otherwise(0)
    return spark.range(n).select("id", label.cast("int").alias("label"), F.concat(F.lit("text "), F.col("id")).alias("text"))


@pytest.mark.parametrize("n", [1, 40, 100, 5000])
def test_samples_equal_those_of_the_whole_table(spark, tmp_path, n):
    df = table(spark, 6000)
    L.write_layout(df, str(tmp_path / "t"), seed=7)
    got = L.sample_layout(spark, str(tmp_path / "t"), n)
    whole = sampling.sample_by_class(spark, df, n, seed=7, labels=None, shuffle=False)
    assert got.columns == whole.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def rows_read(df):
    """Rows that the scan hands over."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_a_small_sample_reads_few_rows(spark, tmp_path):
    L.write_layout(table(spark, 300_000), str(tmp_path / "t"), row_group_bytes=1 << 16)
    read = rows_read(L.read_first(spark, str(tmp_path / "t"), 500))
    kept = L.read_first(spark, str(tmp_path / "t"), 500).count()
    assert 1500 <= kept < 1600  # three classes, and the rest of a bucket each
    assert read < 60_000


def test_empty_table_and_own_column(spark, tmp_path):
    L.write_layout(table(spark, 0), str(tmp_path / "t"))
    assert L.sample_layout(spark, str(tmp_path / "t"), 5).collect() == []
    with pytest.raises(ValueError):
        L.write_layout(spark.range(1).select("id", F.lit("x").alias(L.KEY)), str(tmp_path / "u"))
