"""Row sampling by arbitrary weights (R5, general form).

``weighted_draws``: ``n`` independent draws with replacement, each row with
probability weight / total. Weights become whole parts (``2**PART_BITS`` for the
largest one, at least one for any other above zero), so all sums are exact and
do not depend on partitioning. Rows are laid end to end in the order of a seeded
hash; a draw is a uniform place on this line, and two levels find its row:

1. the hash's leading digits split the rows into buckets; bucket totals are
   summed up in two steps (inside groups of buckets, then over the groups).
   The line is cut into ``CELLS`` equal cells, a bucket is listed under the
   cells it touches, and a draw meets the buckets of its own cell only;
2. inside drawn buckets, rows are listed in the same way under cells of the
   bucket. A bucket has a cell per row and one per ``CELL_DRAWS`` draws expected
   there, so a row that takes a third of all draws is spread over many keys.

No window spans more than a bucket of rows, a group of buckets or the groups.

``weighted_without_replacement``: exactly ``n`` rows with the smallest
exponential keys ``-ln(u) / weight``. The cut is found by counting keys in
logarithmic bins, then in equal bins inside the bin that holds the cut; only the
rows of one such bin are sorted.

Null, negative, NaN and infinite weights raise, as do repeated ids that a
window sees, a total of zero, and more rows without replacement than have a
weight above zero. Rows of weight zero are never taken.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions.hashing import bucket_of, hex_prefix_int, seeded_key
from labelscope.operators.ranking import bounded_broadcast
from labelscope.session import stage_table

PART_BITS = 50
CELLS = 1 << 16
CELL_DRAWS = 1024
#: Hash digits of a bucket (16**5 buckets), and of a group of buckets.
DIGITS, GROUP_DIGITS = 5, 2
#: Equal bins inside the logarithmic bin of the cut, and bins per unit of ln.
FINE_BINS, LOG_BINS = 1 << 16, 64

_WHOLE = "decimal(38,0)"


def check_weights(df: DataFrame, weight_col: str) -> tuple[float, int]:
    """The largest weight and the number of weights above zero."""
    w = F.col(weight_col).cast("double")
    bad = w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf"))
    row = df.agg(F.count_if(bad).alias("bad"), F.max(w).alias("top"), F.count_if(w > 0).alias("some")).first()
    if row["bad"]:
        raise ValueError(f"{row['bad']} weights in {weight_col} are null, negative, NaN or infinite")
    if not row["some"]:
        raise ValueError(f"no weight in {weight_col} is above zero")
    return row["top"], row["some"]


def weight_parts(weight_col: str, top: float) -> Column:
    """Whole parts of a weight: ``2**PART_BITS`` for the largest."""
    w = F.col(weight_col).cast("double")
    parts = F.floor(w / F.lit(float(top)) * F.lit(float(1 << PART_BITS)) + 0.5)
    return F.when(w > 0, F.greatest(parts, F.lit(1))).otherwise(F.lit(0)).cast("bigint")


def _uniform_place(seed, total: int) -> Column:
    """A place 0 .. total - 1 from 120 hash bits of the draw's number."""
    h = seeded_key(seed, F.lit("place"), "draw")
    high, low = hex_prefix_int(h, 15), hex_prefix_int(F.substring(h, 16, 15), 15)
    bits = high.cast("decimal(19,0)") * F.lit(Decimal(1 << 60)).cast("decimal(19,0)") + low.cast("decimal(19,0)")
    return (bits % F.lit(Decimal(total)).cast(_WHOLE)).cast(_WHOLE)


def _bucket_line(rows: DataFrame) -> DataFrame:
    """``(bucket, total, rows, lo, hi)``: the stretch of every bucket on the line."""
    totals = rows.groupBy("_bucket").agg(F.sum("_parts").cast(_WHOLE).alias("_total"), F.count(F.lit(1)).alias("_rows"))
    totals = totals.withColumn("_group", F.shiftright("_bucket", 4 * (DIGITS - GROUP_DIGITS)))
    inner = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = totals.withColumn("_to", F.sum("_total").over(inner).cast(_WHOLE))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)  # <= 16**GROUP_DIGITS rows
    groups = totals.groupBy("_group").agg(F.sum("_total").cast(_WHOLE).alias("_all")).select(
        "_group", F.coalesce(F.sum("_all").over(before), F.lit(0)).cast(_WHOLE).alias("_base"))
    line = totals.join(F.broadcast(groups), "_group")
    return line.select("_bucket", "_total", "_rows", (F.col("_base") + F.col("_to") - F.col("_total")).cast(_WHOLE).alias("_lo"),
                       (F.col("_base") + F.col("_to")).cast(_WHOLE).alias("_hi"))


def _cells(lo: str, hi: str, width) -> Column:
    """Numbers of the cells that a stretch touches."""
    return F.explode(F.sequence(F.expr(f"{lo} div {width}"), F.expr(f"({hi} - 1) div {width}")))


def weighted_draws(df: DataFrame, weight_col: str, n: int, *, seed=42, id_cols: Sequence[str] = ("id",),
                   columns: Sequence[str] | None = None) -> DataFrame:
    """``(draw, *columns)``: ``n`` draws with replacement, ``draw`` from 0 to
    ``n - 1``; ``columns`` (all by default) come along with the drawn row."""
    spark, ids = df.sparkSession, list(id_cols)
    columns = list(df.columns if columns is None else columns)
    top, _ = check_weights(df, weight_col)
    rows = df.select(F.struct(*columns).alias("_row"), F.struct(*ids).alias("_id"), weight_parts(weight_col, top).alias("_parts"),
                     seeded_key(seed, F.lit("row"), *ids).alias("_key")).where("_parts > 0")
    rows = rows.withColumn("_bucket", bucket_of("_key", DIGITS))
    line = stage_table(_bucket_line(rows), "weight-line")
    total = int(line.agg(F.max("_hi")).first()[0])
    width = -(-total // CELLS)
    share = F.col("_total").cast("double") * (float(n) / float(total))
    cells = F.col("_rows") + F.ceil(share / CELL_DRAWS)
    line = line.withColumn("_width", F.ceil(F.col("_total") / cells.cast("decimal(19,0)")).cast(_WHOLE))
    buckets = 16 ** DIGITS

    stretches = line.select("_bucket", "_lo", "_hi", "_width", _cells("_lo", "_hi", f"{width}BD").alias("_cell"))
    draws = spark.range(int(n)).select(F.col("id").alias("draw")).select("draw", _uniform_place(seed, total).alias("_at"))
    draws = draws.withColumn("_cell", F.expr(f"_at div {width}BD"))
    placed = (draws.join(bounded_broadcast(stretches, buckets + CELLS), "_cell")
              .where((F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi")))
              .select("draw", "_bucket", (F.col("_at") - F.col("_lo")).cast(_WHOLE).alias("_at"), "_width"))
    placed = placed.withColumn("_cell", F.expr("_at div _width")).drop("_width")
    placed = stage_table(placed, "weight-draws")

    drawn = placed.select("_bucket").distinct()
    here = rows.join(bounded_broadcast(drawn, buckets), "_bucket", "left_semi")
    order = Window.partitionBy("_bucket").orderBy("_key", "_id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    again = (F.lag("_key").over(order) == F.col("_key")) & (F.lag("_id").over(order) == F.col("_id"))
    here = here.select("_bucket", "_row", "_parts", F.sum("_parts").over(upto).cast(_WHOLE).alias("_to"),
                       F.when(again, F.raise_error(F.lit(f"key {ids} is not unique")).cast("boolean")).otherwise(F.lit(True)).alias("_one"))
    here = here.join(bounded_broadcast(line.select("_bucket", "_width"), buckets), "_bucket").where("_one")
    here = here.withColumn("_from", (F.col("_to") - F.col("_parts")).cast(_WHOLE))
    here = here.select("_bucket", "_row", "_from", "_to", _cells("_from", "_to", "_width").alias("_cell"))
    met = placed.join(here, ["_bucket", "_cell"]).where((F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to")))
    return met.select("draw", *(F.col("_row")[c].alias(c) for c in columns))


def exponential_key(weight_col: str, seed, id_cols: Sequence[str]) -> Column:
    """``-ln(u) / weight`` with ``u`` in (0, 1] from the row's hash; null for weight 0."""
    u = (hex_prefix_int(seeded_key(seed, F.lit("key"), *id_cols), 12) + 1).cast("double") / F.lit(float(1 << 48))
    w = F.col(weight_col).cast("double")
    return F.when(w > 0, -F.log(u) / w)


def _cut(counts: DataFrame, bin_col: str, n: int) -> tuple[int, int]:
    """The bin that holds the ``n``-th key, and the keys before that bin
    (``counts``: one row per bin, a bounded table)."""
    upto = Window.orderBy(bin_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    row = counts.withColumn("_upto", F.sum("_n").over(upto)).where(F.col("_upto") >= n).orderBy(bin_col).first()
    return row[bin_col], row["_upto"] - row["_n"]


def weighted_without_replacement(df: DataFrame, weight_col: str, n: int, *, seed=42,
                                 id_cols: Sequence[str] = ("id",)) -> DataFrame:
    """``n`` different rows; the next one is always taken in proportion to the
    weights of the rows not taken yet."""
    n, ids = int(n), list(id_cols)
    _, some = check_weights(df, weight_col)
    if n > some:
        raise ValueError(f"{n} rows asked for, but only {some} have a weight above zero")
    if n <= 0:
        return df.limit(0)
    key = exponential_key(weight_col, seed, ids)
    logs = F.when(key > 0, F.floor(F.log(key) * LOG_BINS)).otherwise(F.lit(-100_000))
    keyed = df.withColumn("_key", key).where(F.col("_key").isNotNull()).withColumn("_bin", logs.cast("int"))
    bins = keyed.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"), F.min("_key").alias("_low"), F.max("_key").alias("_high"))
    bins = stage_table(bins, "key-bins")
    at, before = _cut(bins, "_bin", n)
    ends = bins.where(F.col("_bin") == at).first()
    span = (ends["_high"] - ends["_low"]) or 1.0
    fine = F.least(F.floor((F.col("_key") - ends["_low"]) / span * FINE_BINS), F.lit(FINE_BINS - 1)).cast("int")
    inside = keyed.where(F.col("_bin") == at).withColumn("_fine", fine)
    fine_at, fine_before = _cut(inside.groupBy("_fine").agg(F.count(F.lit(1)).alias("_n")), "_fine", n - before)
    rest = inside.where(F.col("_fine") == fine_at).orderBy("_key", *ids).limit(n - before - fine_before)
    whole = keyed.where(F.col("_bin") < at).unionByName(inside.where(F.col("_fine") < fine_at).drop("_fine"))
    return whole.unionByName(rest.drop("_fine")).select(*df.columns)
