"""Ranking without a hot partition (R1-R4 building blocks).

``row_number() over (partition by label order by key)`` puts a whole class in
one task; with one class holding a third of the rows that task holds a third
of the data. Instead the random key's leading hex digits split every class
into ``16**digits`` buckets (default 5 digits: about a million buckets, so a
class of 3e11 rows still gives ~3e5 rows per window task):

1. count rows per ``(class, bucket)``  (partial + final hash aggregate; the
   table has at most ``classes * 16**digits`` rows, however large the input),
2. prefix-sum the counts per class -> each bucket's offset,
3. join the offsets back and drop every bucket whose offset is already past
   the class limit; when the surviving offsets have a row bound (from the
   parameters) under ``BROADCAST_ROW_LIMIT`` they are broadcast, so the drop
   happens *before* the exchange and only about ``limit`` rows per class are
   shuffled; past that bound the join is left to AQE (sort-merge join on
   ``(class, bucket)``, whose exchange the window then reuses),
4. ``rank = offset + row_number() over (partition by class, bucket order by key)``.

Because ordering by the key orders by its prefix first, the result equals
the plain global rank, whatever the input partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions.hashing import bucket_of

BUCKET = "_bucket"
BUCKET_ROWS = "_bucket_rows"
OFFSET = "_offset"
DEFAULT_DIGITS = 5
# An explicit broadcast is only hinted for tables whose row count is bounded
# by parameters below this (offset rows are ~32 bytes: <= ~64 MB).
BROADCAST_ROW_LIMIT = 2_000_000


def _as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


def bounded_broadcast(df: DataFrame, row_bound: int | None) -> DataFrame:
    """Broadcast ``df`` only when a parameter-derived row bound is known and small."""
    if row_bound is not None and row_bound <= BROADCAST_ROW_LIMIT:
        return F.broadcast(df)
    return df


def bucket_offsets(keyed: DataFrame, partition_cols: Sequence[str] = ()) -> DataFrame:
    """(partition_cols..., _bucket, _bucket_rows, _offset) from a bucketed table.

    The prefix-sum window runs over the counts table (<= 16**digits rows per
    partition value), never over the data."""
    pcols = list(partition_cols)
    counts = keyed.groupBy(*pcols, BUCKET).agg(F.count(F.lit(1)).alias(BUCKET_ROWS))
    w = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    if pcols:
        w = Window.partitionBy(*pcols).orderBy(BUCKET).rowsBetween(
            Window.unboundedPreceding, -1)
    return counts.withColumn(OFFSET, F.coalesce(F.sum(BUCKET_ROWS).over(w), F.lit(0)).cast("bigint"))


def bucketed_rank(df: DataFrame, key_col: str, tiebreak: Sequence[str] = (),
                  partition_cols: Sequence[str] = (), digits: int = DEFAULT_DIGITS,
                  limits: DataFrame | None = None, limit_col: str = "_limit",
                  limit: int | None = None, domain_size: int | None = None,
                  rank_col: str = "rank", keep_columns: bool = False, unique: bool = False) -> DataFrame:
    """1-based rank of every row by ``(key_col, *tiebreak)`` within ``partition_cols``.
    With ``unique``, ranked rows with equal keys and tiebreaks raise.

    ``key_col`` must be a lowercase hex string (an md5). ``limits`` is an
    optional table ``(partition_cols..., limit_col)`` and ``limit`` a scalar;
    rows whose rank would exceed them are pruned by whole buckets before the
    shuffle (when the pruned offsets are provably small) and then exactly.
    ``domain_size`` is the number of partition values when it is known from
    parameters (a fixed label list); it bounds the offsets table.
    """
    pcols = list(partition_cols)
    keyed = df.withColumn(BUCKET, bucket_of(key_col, digits))
    offsets = bucket_offsets(keyed, pcols)
    if limits is not None:
        offsets = (offsets.join(bounded_broadcast(limits.select(*pcols, limit_col), domain_size),
                                pcols, "inner")
                   .where(F.col(OFFSET) < F.col(limit_col)))
    if limit is not None:
        offsets = offsets.where(F.col(OFFSET) < F.lit(int(limit)))
    # row bound of the surviving offsets: buckets per partition value, cut by
    # the limit (a surviving bucket starts before it, so it holds >= 1 of the
    # first `limit` rows), times the number of partition values
    per_value = 16 ** digits if limit is None else min(16 ** digits, int(limit))
    n_values = 1 if not pcols else domain_size
    bound = None if n_values is None else per_value * n_values
    joined = keyed.join(bounded_broadcast(offsets, bound), pcols + [BUCKET], "inner")
    w = Window.partitionBy(*pcols, BUCKET).orderBy(F.col(key_col), *[F.col(c) for c in tiebreak])
    place = F.row_number().over(w)
    if unique:
        same = F.lag(key_col).over(w) == F.col(key_col)
        for c in tiebreak:
            same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
        place = F.when(same, F.raise_error(F.lit(f"key {list(tiebreak)} is not unique")).cast("int")).otherwise(place)
    ranked = joined.withColumn(rank_col, F.col(OFFSET) + place)
    if limits is not None:
        ranked = ranked.where(F.col(rank_col) <= F.col(limit_col))
    if limit is not None:
        ranked = ranked.where(F.col(rank_col) <= F.lit(int(limit)))
    if not keep_columns:
        drop = [BUCKET, BUCKET_ROWS, OFFSET]
        if limits is not None:
            drop.append(limit_col)
        ranked = ranked.drop(*drop)
    return ranked


def shuffled_row_id(df: DataFrame, seed, id_cols: Sequence[str], digits: int = DEFAULT_DIGITS,
                    out: str = "row_id") -> DataFrame:
    """Seeded random permutation, then consecutive 0-based ids.
    Repeated values of ``id_cols`` raise: their order would not be defined."""
    from labelscope.functions.hashing import seeded_key

    ids = _as_list(id_cols)
    keyed = df.withColumn("_shuffle_key", seeded_key(seed, *ids))
    ranked = bucketed_rank(keyed, "_shuffle_key", tiebreak=ids, digits=digits, rank_col=out, unique=True)
    return ranked.withColumn(out, (F.col(out) - 1).cast("bigint")).drop("_shuffle_key")


def row_ids(df: DataFrame, order_col: str, tiebreak: Sequence[str] = (), out: str = "row_id") -> DataFrame:
    """Consecutive 0-based ids in ``order_col`` order, without one global task.

    Spark's range partitioning sorts the rows once; they are staged with their
    place (partition, row in it), the partitions are counted (one small row
    each), and an id is the partition's offset plus the row's place. The order
    columns must be a key; equal ones raise. An empty table has no ids."""
    from labelscope.session import stage_table

    order = [order_col, *tiebreak]
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
              .withColumn("_place", F.monotonically_increasing_id()))
    staged = stage_table(placed, "row-ids")
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    w = Window.partitionBy("_part").orderBy("_place")
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w)) & (F.lag(F.lit(1)).over(w).isNotNull())
    error = F.raise_error(F.lit(f"key {order} is not unique")).cast("bigint")
    counts = (staged.select(part.alias("_part"), "_place", *order).withColumn("_one", F.when(same, error).otherwise(F.lit(1)))
              .groupBy("_part").agg(F.sum("_one").alias("_rows")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # <= partitions rows
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    rows = staged.withColumn("_part", part)
    return (rows.join(bounded_broadcast(offsets, parts), "_part")
            .withColumn(out, (F.col("_before") + place).cast("bigint")).drop("_part", "_place", "_before"))


def batch_ids(df: DataFrame, row_id_col: str = "row_id", batch_size: int = 16,
              out: str = "batch") -> DataFrame:
    """Consecutive batches of ``batch_size`` rows over 0-based row ids; the last may be short."""
    return df.withColumn(out, F.floor(F.col(row_id_col) / int(batch_size)).cast("bigint"))


def assert_unique(df: DataFrame, key_cols: Sequence[str]) -> None:
    """Raise if ``key_cols`` is not a key (ranks would not be deterministic)."""
    dup = df.groupBy(*key_cols).count().where(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"key {list(key_cols)} is not unique, e.g. {dup[0].asDict()}")
