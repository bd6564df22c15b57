"""The profile cube (T9) against the single profiles; checked writes (V1-V7)."""

import random

import pytest

from labelscope.operators import checked_write, cube, profile, submission


def corpus(spark, seed=1, n=400):
    rng = random.Random(seed)
    rows = [(rng.choice([0, 0, 0, 1, 2, None]), rng.choice(["C", "Go", None]), rng.choice([f"g{k}" for k in range(30)] + [None]),
             rng.choice([None, "", "x" * rng.randrange(1, 50)])) for _ in range(n)]
    return spark.createDataFrame(rows, "label int, language string, generator string, code string").repartition(3)


def same(a, b, digits=9):
    norm = lambda rows: sorted((tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    assert norm(a.select(*b.columns).collect()) == norm(b.collect())


def test_tables_equal_the_single_profiles(spark):
    df = corpus(spark)
    c = cube.profile_cube(df)
    same(cube.cube_distribution(spark, c, [0, 1, 2], ["a", "b", "c"]), profile.label_distribution(spark, df, "label", [0, 1, 2], ["a", "b", "c"]))
    same(cube.cube_values(c, "language"), profile.value_counts(df, "language"))
    same(cube.cube_top(c, "generator", 20), profile.top_values(df, "generator", 20))
    same(cube.cube_lengths(c), profile.length_describe(df))
    same(cube.cube_summary(c), profile.corpus_profile(df))


def test_one_scan_and_one_exchange(spark, tmp_path):
    corpus(spark).write.parquet(str(tmp_path / "c"))
    plan = cube.profile_cube(spark.read.parquet(str(tmp_path / "c")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1


def test_cubes_add_up(spark):
    a, b = corpus(spark, 1), corpus(spark, 2)
    whole = cube.profile_cube(a.unionByName(b))
    merged = cube.merge_cubes(cube.profile_cube(a), cube.profile_cube(b))
    same(merged, whole)


def test_missing_columns_and_empty_corpus(spark):
    df = spark.createDataFrame([(1, "abc"), (None, None)], "label int, code string")
    c = cube.profile_cube(df)
    r = cube.cube_summary(c).first()
    assert (r["rows"], r["n_classes"], r["n_languages"], r["max_length"]) == (2, 1, 0, 3)
    empty = cube.profile_cube(df.limit(0))
    assert cube.cube_lengths(empty).first()["count"] == 0 and cube.cube_values(empty, "language").collect() == []


SUBMISSIONS = {
    "good": [(str(i), str(i % 11)) for i in range(500)],
    "repeats": [(str(i % 450), "3") for i in range(500)],
    "forms of one id": [("1", "0"), ("01", "1"), ("+1", "2"), ("2", "0")],
    "sparse": [(str(i * 10**12), "1") for i in range(40)] + [("0", "1")],
    "far ends": [(str(2**63 - 1), "1"), (str(-(2**63)), "1"), (str(2**63 - 1), "1")],
    "negative": [(str(i), "1") for i in range(-70_000, -69_000)] + [("-69500", "2")],
    "bad types": [("a", "1"), ("a", "x"), ("1.5", "2.0"), ("7", "99"), ("8", "-1"), (None, "1"), (None, None), ("99999999999999999999", "1")],
    "none": [],
}


@pytest.mark.parametrize("kind", sorted(SUBMISSIONS))
def test_checked_write_equals_the_checks(spark, tmp_path, kind):
    df = spark.createDataFrame(SUBMISSIONS[kind], "id string, label string").repartition(3)
    checks, summary = checked_write.write_checked(spark, df, str(tmp_path / "s"))
    assert sorted(map(tuple, checks.collect())) == sorted(map(tuple, submission.submission_checks(spark, df).collect()))
    valid = df.where(df["label"].try_cast("bigint").between(0, 10))
    assert sum(r["count"] for r in summary.collect()) == valid.count()
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == len(SUBMISSIONS[kind])


def test_checked_write_without_the_columns(spark, tmp_path):
    checks, summary = checked_write.write_checked(spark, spark.createDataFrame([("1",)], "ID string"), str(tmp_path / "s"))
    assert [tuple(r) for r in checks.collect()] == [(1, "columns", False, 0)] and summary.collect() == []
