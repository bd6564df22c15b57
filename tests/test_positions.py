"""Positions from files and alignment by them."""

import pytest
from pyspark.sql import functions as F

from labelscope.sources.positions import align_positions, file_offsets, read_positions


def written(spark, path, n, parts, **cols):
    df = spark.range(n).repartitionByRange(parts, "id").sortWithinPartitions("id")
    df.select("id", *(F.expr(e).alias(c) for c, e in cols.items())).write.parquet(str(path))
    return str(path)


def test_positions_follow_files_and_rows(spark, tmp_path):
    path = written(spark, tmp_path / "t", 5000, 7, x="id * 2")
    files = file_offsets(spark, path).orderBy("file").collect()
    assert len(files) == 7 and sum(f["rows"] for f in files) == 5000 and files[3]["offset"] == sum(f["rows"] for f in files[:3])
    got = read_positions(spark, path)
    assert got.columns == ["position", "id", "x"]
    assert got.where("position <> id or x <> 2 * id").count() == 0 and got.count() == 5000


def test_positions_need_no_shuffle_of_the_rows(spark, tmp_path):
    path = written(spark, tmp_path / "t", 100, 3)
    plan = read_positions(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_row_groups_and_several_paths(spark, tmp_path):
    spark.range(3000).coalesce(1).write.option("parquet.block.size", 1024).parquet(str(tmp_path / "a"))
    spark.range(3000, 3500).coalesce(1).write.parquet(str(tmp_path / "b"))
    got = read_positions(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert got.where("position <> id").count() == 0 and got.agg(F.max("position")).first()[0] == 3499


def test_filters_and_empty_tables(spark, tmp_path):
    path = written(spark, tmp_path / "t", 400, 4)
    assert [r["position"] for r in read_positions(spark, path).where("id > 396").orderBy("id").collect()] == [397, 398, 399]
    empty = written(spark, tmp_path / "e", 0, 1)
    assert read_positions(spark, empty).collect() == []
    assert align_positions(read_positions(spark, empty), read_positions(spark, empty).withColumnRenamed("id", "b")).collect() == []


def test_aligned_tables_of_different_files(spark, tmp_path):
    a = read_positions(spark, written(spark, tmp_path / "a", 1000, 3, label="id % 7"), ["label"])
    b = read_positions(spark, written(spark, tmp_path / "b", 1000, 5, y="id % 3"), ["y", "id"])
    got = align_positions(a, b)
    assert got.columns == ["position", "label", "y", "id"]
    assert got.count() == 1000 and got.where("label <> id % 7 or y <> id % 3 or position <> id").count() == 0


def test_unequal_lengths_and_repeats_raise(spark, tmp_path):
    a = read_positions(spark, written(spark, tmp_path / "a", 10, 2), ["id"])
    b = read_positions(spark, written(spark, tmp_path / "b", 9, 2, y="id"), ["y"])
    with pytest.raises(Exception, match="only the left table has a row at position 9"):
        align_positions(a, b).collect()
    with pytest.raises(Exception, match="only the right table has a row at position 9"):
        align_positions(b, a).collect()
    with pytest.raises(Exception, match="not one row at position"):
        align_positions(a, b.unionByName(b)).where("position < 9").collect()
    with pytest.raises(ValueError):
        align_positions(a, a)


def test_null_values_stay(spark, tmp_path):
    a = read_positions(spark, written(spark, tmp_path / "a", 4, 2, x="if(id = 2, null, id)"), ["x"])
    b = read_positions(spark, written(spark, tmp_path / "b", 4, 1, y="if(id = 1, null, id)"), ["y"])
    assert sorted(tuple(r) for r in align_positions(a, b).select("position", F.coalesce("x", F.lit(-1)), F.coalesce("y", F.lit(-1))).collect()) == [
        (0, 0, 0), (1, 1, -1), (2, -1, 2), (3, 3, 3)]
