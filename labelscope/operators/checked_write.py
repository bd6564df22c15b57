"""A submission judged while it is written (V1-V7).

One pass writes the table; counts of bad ids and labels, missing values and
rows per label are observed in that pass (``Observation``). Repeated ids are the
one check that needs more: whole-number ids, where they lie dense enough, are
reduced to bitmaps of 32,768 ids each, which merge before they are shuffled
(an id takes a bit or so, not a row); only where a bitmap has fewer bits than rows are the
ids themselves counted. Sparse or other ids are counted by value.

Observed counts are those of the successful write; a stage that is run again
after a lost executor may be observed twice, so the rows written are counted
and a difference raises.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from labelscope.operators.submission import VALID_LABELS, _is_int
from labelscope.sources.io import has_column, read_csv

#: Ids count as dense when their range is at most so many times their number.
DENSE = 64

CHECKS = ("columns", "id_integer", "label_integer", "label_range", "unique_id", "no_missing")


def repeated_rows(ids: DataFrame, n: int, low: int | None, high: int | None) -> int:
    """Rows of ``ids(id)`` (text) whose id occurs more than once; ``low`` and
    ``high``: the smallest and largest whole number among ``n`` ids."""
    number = F.col("id").try_cast("bigint")
    others = ids.where(number.isNull()).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    numbers = ids.select(number.alias("id")).where("id is not null")
    if low is not None and high - low < DENSE * n:
        place = F.col("id") - F.lit(low)
        numbers = numbers.select("id", F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
        maps = numbers.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bitmap_construct_agg("bit").alias("bits"))
        full = maps.where(F.col("n") > F.bitmap_count("bits")).select("bucket")
        numbers = numbers.join(full, "bucket", "left_semi")
    counted = numbers.groupBy("id").agg(F.count(F.lit(1)).alias("n")).select("n").unionByName(others.select("n"))
    return counted.where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def write_checked(spark: SparkSession, df: DataFrame, path: str, valid_labels: Sequence[int] = VALID_LABELS) -> tuple[DataFrame, DataFrame]:
    """Write ``df`` as CSV with header and return ``(checks, summary)``: the rows
    of ``submission_checks``, and ``(label, count, pct, total)`` of the valid labels."""
    checked = "check_id int, check string, passed boolean, bad_rows bigint"
    summary = "label int, count bigint, pct double, total bigint"
    if not (has_column(df, "id") and has_column(df, "label")):
        df.write.mode("overwrite").option("header", True).csv(path)
        return spark.createDataFrame([(1, "columns", False, 0)], checked), spark.createDataFrame([], summary)
    label, number = F.col("label").cast("string").try_cast("bigint"), F.col("id").cast("string").try_cast("bigint")
    missing = F.lit(False)
    for c in df.columns:
        missing = missing | F.col(c).isNull()
    valid = [int(x) for x in valid_labels]
    seen = Observation("submission")
    observed = df.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(_is_int("id"), F.lit(False))).alias("bad_id"),
        F.count_if(~F.coalesce(_is_int("label"), F.lit(False))).alias("bad_label"),
        F.count_if(label.isNotNull() & ~label.isin(valid)).alias("invalid"), F.count_if(missing).alias("missing"),
        F.min(number).alias("low"), F.max(number).alias("high"), *(F.count_if(label == x).alias(f"label_{x}") for x in valid))
    observed.write.mode("overwrite").option("header", True).csv(path)
    m = seen.get
    ids = read_csv(spark, path).select("id")
    written = ids.count()
    if written != m["rows"]:
        raise RuntimeError(f"{m['rows']} rows were observed, but {written} written: a stage ran twice; write again")
    bad = (0, m["bad_id"], m["bad_label"], m["invalid"], repeated_rows(ids, m["rows"], m["low"], m["high"]), m["missing"])
    rows = [(i + 1, name, n == 0, int(n)) for i, (name, n) in enumerate(zip(CHECKS, bad, strict=True))]
    total = m["rows"]
    counts = [(x, m[f"label_{x}"], 100.0 * m[f"label_{x}"] / total, total) for x in valid if m[f"label_{x}"]]
    return spark.createDataFrame(rows, checked), spark.createDataFrame(counts, summary)
