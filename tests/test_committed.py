"""Record files with a commit step."""

import glob
import gzip
import math
import os

import pytest
from pyspark.sql import functions as F

from labelscope.sources.committed import CommittedJson, read_manifest


@pytest.fixture(scope="module", autouse=True)
def source(spark):
    spark.dataSource.register(CommittedJson)


def save(df, path, mode="overwrite"):
    df.write.format("committed_json").mode(mode).save(str(path))


def load(spark, path):
    return spark.read.format("committed_json").load(str(path))


ROWS = [(1, "a\nb", 1.5, True, [1, 2]), (2, None, math.nan, None, []), (3, "ü \U0001f642 \x00 \"", -math.inf, False, None), (None, "", 0.1, True, [None])]
SCHEMA = "id bigint, text string, x double, ok boolean, list array<int>"


def same(a, b):
    norm = lambda rows: sorted((tuple(str(x) for x in r) for r in rows))
    assert norm(a.collect()) == norm(b.collect())


def test_rows_come_back(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    save(df, tmp_path / "t")
    got = load(spark, tmp_path / "t")
    assert got.schema == df.schema
    same(got, df)


def test_append_overwrite_and_empty(spark, tmp_path):
    df = spark.range(100).repartition(4)
    save(df, tmp_path / "t")
    save(df, tmp_path / "t", "append")
    assert load(spark, tmp_path / "t").count() == 200
    save(df.limit(7), tmp_path / "t")
    assert load(spark, tmp_path / "t").count() == 7
    save(df.limit(0), tmp_path / "t")
    assert load(spark, tmp_path / "t").collect() == [] and load(spark, tmp_path / "t").columns == ["id"]
    with pytest.raises(Exception, match="another schema"):
        save(df.select(F.col("id").cast("string").alias("id")), tmp_path / "t", "append")


def test_files_of_lost_tasks_are_not_read(spark, tmp_path):
    df = spark.range(50).repartition(2)
    save(df, tmp_path / "t")
    with open(tmp_path / "t" / "part-stray.json.gz", "wb") as f:
        f.write(gzip.compress(b"[999]\n")[:-5])
    same(load(spark, tmp_path / "t"), df)


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    save(spark.range(10), tmp_path / "t")
    before = read_manifest(str(tmp_path / "t"))
    bad = spark.range(10).repartition(3).select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        save(bad, tmp_path / "t")
    assert read_manifest(str(tmp_path / "t")) == before and load(spark, tmp_path / "t").count() == 10


def test_changed_files_raise(spark, tmp_path):
    save(spark.range(10).coalesce(1), tmp_path / "t")
    [name] = glob.glob(str(tmp_path / "t" / "part-*.json.gz"))
    with open(name, "wb") as f:
        f.write(gzip.compress(b"[1]\n"))
    with pytest.raises(Exception, match="not the file that was committed"):
        load(spark, tmp_path / "t").collect()
    os.truncate(name, 5)
    with pytest.raises(Exception):
        load(spark, tmp_path / "t").collect()


def test_other_types_raise(spark, tmp_path):
    with pytest.raises(Exception, match="cannot be stored"):
        save(spark.range(1).select(F.current_date().alias("d")), tmp_path / "t")
