"""Seeded exact-size sampling and class balancing.

Randomness contract (S2/S3): a row's key is ``md5('<seed>:<id>')``; a
with-replacement draw ``i`` of class ``c`` picks rank
``md5('<seed>:<c>:<i>')[:15] mod count(c) + 1`` (60 bits, so the remainder's
bias stays below 1e-6 for classes of up to 1e12 rows). Same seed and input give the
same rows whatever the partitioning; every size is exact.

Physical plan. One narrow aggregate gives the per-class row counts (at most
one row per class reaches the driver), from which the per-class plan is
decided; then every class takes one of three paths:

* keep all rows: a filter on the label, no shuffle at all;
* keep the first ``n`` rows by key (R1): bucketed rank (``ranking.py``) whose
  offsets are pruned to buckets that start before ``n`` -- a table with an
  exact, parameter-derived row bound, broadcast when small -- so only about
  ``n`` rows of the class are shuffled, however hot the class is;
* bootstrap to ``n`` rows (R2): a generated draws table (``n`` rows per
  class) is equi-joined on ``(label, rank)`` to the ranked class; ranks are
  uniform, so the join key is not hot. Only the buckets holding a drawn rank
  are ranked (at most ``n`` buckets per class), on ids alone; the other columns
  join the drawn ids once.

Per-class values are CASE expressions for a few classes and a broadcast plan
table (at most ``MAX_PLAN_CLASSES`` rows) beyond ``CASE_MAX_CLASSES``.

The branches are glued by ``unionByName`` (U1) and, when asked, get
consecutive ids in seeded random order (R3).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelscope.functions.hashing import bucket_of, hex_prefix_int, seeded_key
from labelscope.operators.profile import label_counts
from labelscope.session import stage_table
from labelscope.operators.ranking import (BUCKET, BUCKET_ROWS, DEFAULT_DIGITS, OFFSET,
                                          bounded_broadcast, bucket_offsets, shuffled_row_id)

REFERENCE_LABELS = list(range(11))
# with an open label domain, refuse to plan more classes than this
MAX_PLAN_CLASSES = 100_000
# hex digits of a draw's hash: 60 bits
DRAW_DIGITS = 15
# draws generated by one row of the plan
DRAW_BLOCK = 10_000
# per-class values are CASE expressions up to this many classes, a join beyond
CASE_MAX_CLASSES = 64


def class_counts(df: DataFrame, label_col: str = "label",
                 labels: Sequence[int] | None = REFERENCE_LABELS) -> dict[int, int]:
    """Rows per class (partial + final aggregate; <= one row per class to the driver).

    With ``labels`` every listed class is present (0 where absent); without,
    the distinct labels are collected, at most ``MAX_PLAN_CLASSES``."""
    src = _in_domain(df, label_col, labels)
    agg = src.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    rows = agg.limit(MAX_PLAN_CLASSES + 1).collect()
    if len(rows) > MAX_PLAN_CLASSES:
        raise ValueError(f"more than {MAX_PLAN_CLASSES} classes in {label_col}: pass labels=")
    got = {int(r[0]): int(r[1]) for r in rows}
    if labels is None:
        return dict(sorted(got.items()))
    return {int(x): got.get(int(x), 0) for x in labels}


def _in_domain(df: DataFrame, label_col: str, labels: Sequence[int] | None) -> DataFrame:
    if labels is not None:
        return df.where(F.col(label_col).isin([int(x) for x in labels]))
    return df.where(F.col(label_col).isNotNull())


def _case(label_col: str, values: dict[int, int]) -> Column:
    """``CASE label WHEN k THEN v ... END`` over a per-class dict (<= one entry per class)."""
    expr = None
    for k, v in values.items():
        cond = F.col(label_col) == F.lit(int(k))
        expr = F.when(cond, F.lit(int(v))) if expr is None else expr.when(cond, F.lit(int(v)))
    return expr.cast("bigint")


def _attach(df: DataFrame, label_col: str, values: dict[int, int], name: str) -> DataFrame:
    """Add the per-class value ``values[label]`` as column ``name``: a CASE
    expression for a few classes, else a broadcast join to the plan table
    (<= MAX_PLAN_CLASSES rows), which keeps the generated code small."""
    if len(values) <= CASE_MAX_CLASSES:
        return df.withColumn(name, _case(label_col, values))
    plan = df.sparkSession.createDataFrame([(int(k), int(v)) for k, v in values.items()],
                                           f"_plan_label BIGINT, {name} BIGINT")
    return (df.join(F.broadcast(plan), F.col(label_col).cast("bigint") == F.col("_plan_label"), "left")
            .drop("_plan_label"))


def _id_str(id_cols: Sequence[str]) -> Column:
    return F.concat_ws(":", *[F.col(c).cast("string") for c in id_cols])


def _checked_rank(w, id_cols: Sequence[str]) -> Column:
    """``row_number`` over a window ordered by ``_key``; raises where two rows
    have the same key, that is the same id (a sample of them is not defined)."""
    same = F.lag("_key").over(w) == F.col("_key")
    error = F.raise_error(F.concat(F.lit(f"key {list(id_cols)} is not unique: "), _id_str(id_cols)))
    return F.when(same, error.cast("int")).otherwise(F.row_number().over(w))


def _rank_classes(df: DataFrame, seed, id_cols: Sequence[str], label_col: str,
                  limits: dict[int, int], digits: int) -> DataFrame:
    """Rows of the classes in ``limits`` with ``_rank`` (1-based, by seeded key)
    and ``_rank <= limits[class]``. Offsets are pruned to buckets starting
    before the limit; their row bound is exact, so they are broadcast when small."""
    classes = list(limits)
    keyed = (df.where(F.col(label_col).isin(classes))
             .withColumn("_key", seeded_key(seed, *id_cols))
             .withColumn(BUCKET, bucket_of("_key", digits)))
    offsets = (_attach(bucket_offsets(keyed, [label_col]), label_col, limits, "_limit")
               .where(F.col(OFFSET) < F.col("_limit")))
    bound = sum(min(16 ** digits, int(v)) for v in limits.values())
    w = Window.partitionBy(label_col, BUCKET).orderBy("_key", *id_cols)
    return (keyed.join(bounded_broadcast(offsets, bound), [label_col, BUCKET], "inner")
            .withColumn("_rank", F.col(OFFSET) + _checked_rank(w, id_cols))
            .where(F.col("_rank") <= F.col("_limit"))
            .drop(BUCKET, BUCKET_ROWS, OFFSET, "_key", "_limit"))


def _draws(spark: SparkSession, label_col: str, draws: dict[int, int], sizes: dict[int, int],
           seed) -> DataFrame:
    """``draws[c]`` with-replacement draws of class ``c``: (label, _draw, _rank),
    rank uniform in ``1..sizes[c]``, generated rows (no data read): the plan's
    rows are split into blocks of ``DRAW_BLOCK`` draws, which are spread before
    they are exploded, whatever the number of classes or draws."""
    plan = spark.createDataFrame([(int(c), int(n), int(sizes[c])) for c, n in draws.items()], "_l INT, _n BIGINT, _size BIGINT")
    blocks = plan.select("_l", "_n", "_size", F.explode(F.sequence(
        F.lit(0).cast("bigint"), (F.col("_n") - 1).cast("bigint"), F.lit(DRAW_BLOCK).cast("bigint"))).alias("_from"))
    draw = F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + DRAW_BLOCK, F.col("_n")) - 1))
    gen = blocks.repartition("_l", "_from").select(F.col("_l").alias(label_col), "_size", draw.alias("_draw"))
    return gen.select(label_col, "_draw", (F.pmod(hex_prefix_int(seeded_key(seed, label_col, "_draw"), DRAW_DIGITS),
                                                  F.col("_size")) + 1).alias("_rank"))


def _drawn_rows(df: DataFrame, gen: DataFrame, seed, id_cols: Sequence[str], label_col: str,
                sizes: dict[int, int], n_draws: int, digits: int) -> DataFrame:
    """``(label, id columns, _rank)`` of the rows that some draw of ``gen`` (label,
    _draw, _rank) hits: only the buckets holding a drawn rank are ranked, so
    drawing n rows from a huge class shuffles at most n buckets of it.

    A draw finds its bucket by an equi-join: ranks are cut into blocks of about
    a bucket's width, a bucket is listed under the one or two blocks it reaches,
    and a draw meets the buckets of its own block."""
    keyed = (df.where(F.col(label_col).isin(list(sizes))).select(label_col, *id_cols)
             .withColumn("_key", seeded_key(seed, *id_cols))
             .withColumn(BUCKET, bucket_of("_key", digits)))
    widths = {c: max(1, -(-n // 16 ** digits)) for c, n in sizes.items()}

    def block(df: DataFrame, col: Column) -> Column:
        return F.floor(col / F.col("_width")).cast("bigint")

    offsets = _attach(bucket_offsets(keyed, [label_col]), label_col, widths, "_width")
    reach = F.sequence(block(offsets, F.col(OFFSET)), block(offsets, F.col(OFFSET) + F.col(BUCKET_ROWS) - 1))
    listed = offsets.select(label_col, BUCKET, BUCKET_ROWS, OFFSET, F.explode(reach).alias("_block"))
    hits = _attach(gen.select(label_col, "_rank"), label_col, widths, "_width")
    hits = hits.select(label_col, "_rank", block(hits, F.col("_rank") - 1).alias("_block"))
    needed = (listed.join(hits, [label_col, "_block"])
              .where((F.col("_rank") > F.col(OFFSET)) & (F.col("_rank") <= F.col(OFFSET) + F.col(BUCKET_ROWS)))
              .select(label_col, BUCKET, OFFSET).distinct())
    wr = Window.partitionBy(label_col, BUCKET).orderBy("_key", *id_cols)
    return (keyed.join(bounded_broadcast(needed, n_draws), [label_col, BUCKET], "inner")
            .select(label_col, *id_cols, (F.col(OFFSET) + _checked_rank(wr, id_cols)).alias("_rank")))


def execute_plan(spark: SparkSession, df: DataFrame, counts: dict[int, int],
                 keep: dict[int, int], draw: dict[int, int], *, seed=42,
                 id_cols: Sequence[str] = ("id",), label_col: str = "label",
                 digits: int = DEFAULT_DIGITS, shuffle: bool = True,
                 row_id_col: str = "row_id", stage: bool = True) -> DataFrame:
    """Run a per-class plan: ``keep[c]`` = rows to keep without replacement
    (``>= counts[c]`` keeps the class whole), ``draw[c]`` = rows to draw with
    replacement instead. Output: input columns + ``sample_key`` (unique per
    output row) and, when ``shuffle``, consecutive ``row_id`` in random order.
    R3 reads the sample twice (bucket counts, then ids), so with ``stage``
    the sample is first written under the shared checkpoint folder. Ids must be
    unique among the rows that are ranked; repeated ones raise."""
    id_cols = list(id_cols)
    cols = df.columns
    for c, n in draw.items():
        if n > 0 and counts.get(c, 0) == 0:  # S15
            raise ValueError(f"cannot draw with replacement from empty class {c}")
    whole = [c for c, n in keep.items() if c not in draw and counts.get(c, 0) > 0 and n >= counts[c]]
    cut = {c: n for c, n in keep.items() if c not in draw and 0 < n < counts.get(c, 0)}
    boot = {c: n for c, n in draw.items() if n > 0}
    parts = []
    if whole:
        parts.append(df.where(F.col(label_col).isin(whole))
                     .select(*cols, F.concat(F.lit("k:"), _id_str(id_cols)).alias("sample_key")))
    if cut:
        parts.append(_rank_classes(df, seed, id_cols, label_col, cut, digits)
                     .select(*cols, F.concat(F.lit("k:"), _id_str(id_cols)).alias("sample_key")))
    if boot:
        sizes = {c: counts[c] for c in boot}
        gen = _draws(spark, label_col, boot, sizes, seed)
        pool = _drawn_rows(df, gen, seed, id_cols, label_col, sizes, sum(boot.values()), digits)
        drawn = pool.join(gen, [label_col, "_rank"], "inner").drop("_rank")
        # the wide columns meet the drawn ids once
        rest = df.where(F.col(label_col).isin(list(boot)))
        parts.append(rest.join(drawn, [label_col, *id_cols], "inner").select(
            *cols, F.concat(F.lit("d:"), F.col(label_col).cast("string"), F.lit(":"),
                            F.col("_draw").cast("string")).alias("sample_key")))
    if not parts:
        out = df.limit(0).select(*cols, F.lit(None).cast("string").alias("sample_key"))
    else:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)  # U1
    if shuffle:
        if stage:
            out = stage_table(out, "sample")
        out = shuffled_row_id(out, seed, ["sample_key"], digits=digits, out=row_id_col)
    return out


# ---------------------------------------------------------------- R1 / R9 / R10

def sample_by_class(spark: SparkSession, df: DataFrame, samples_per_class: int = 5000, *,
                    seed=42, id_cols=("id",), label_col="label",
                    labels: Sequence[int] | None = REFERENCE_LABELS, digits: int = DEFAULT_DIGITS,
                    shuffle: bool = True) -> DataFrame:
    """``min(n, count)`` rows per class without replacement."""
    counts = class_counts(df, label_col, labels)
    keep = {c: int(samples_per_class) for c in counts}
    return execute_plan(spark, df, counts, keep, {}, seed=seed, id_cols=id_cols,
                        label_col=label_col, digits=digits, shuffle=shuffle)


def sample_n(df: DataFrame, n: int, *, seed=42, id_cols=("id",), digits: int = DEFAULT_DIGITS,
             rank_col: str = "sample_rank") -> DataFrame:
    """R1/R10 without a class key: ``min(n, count)`` rows, exactly, by seeded key.
    Buckets past ``n`` are dropped before the exchange. Repeated ids among the
    ranked rows raise."""
    from labelscope.operators.ranking import bucketed_rank

    id_cols = list(id_cols)
    keyed = df.withColumn("_key", seeded_key(seed, *id_cols))
    return bucketed_rank(keyed, "_key", tiebreak=id_cols, digits=digits, limit=int(n),
                         rank_col=rank_col, unique=True).drop("_key")


# ---------------------------------------------------------------- R7 / R8

def balance_majority(spark: SparkSession, df: DataFrame, human_samples: int = 50000,
                     oversample_minority: bool = False, target_per_class: int | None = None, *,
                     seed=42, id_cols=("id",), label_col="label", majority_label: int = 0,
                     labels: Sequence[int] = REFERENCE_LABELS, digits: int = DEFAULT_DIGITS,
                     shuffle: bool = True) -> DataFrame:
    """Cut the majority class to ``human_samples`` (all kept when it has no
    more, S4); optionally bootstrap minority classes below ``target_per_class``
    to exactly that size (a pure bootstrap, not "all rows + top-up").
    Labels outside ``labels`` are dropped (S17)."""
    if target_per_class and not oversample_minority:
        raise ValueError("target_per_class needs oversample_minority=True")  # S16
    counts = class_counts(df, label_col, labels)
    keep, draw = {}, {}
    for c, n in counts.items():
        if c == majority_label:
            keep[c] = int(human_samples)
        elif oversample_minority and target_per_class and n < int(target_per_class):
            draw[c] = int(target_per_class)
        else:
            keep[c] = n
    return execute_plan(spark, df, counts, keep, draw, seed=seed, id_cols=id_cols,
                        label_col=label_col, digits=digits, shuffle=shuffle)


def balance_equal(spark: SparkSession, df: DataFrame, samples_per_class: int = 5000, *,
                  seed=42, id_cols=("id",), label_col="label",
                  labels: Sequence[int] = REFERENCE_LABELS, digits: int = DEFAULT_DIGITS,
                  shuffle: bool = True) -> DataFrame:
    """Every class to exactly ``samples_per_class`` (R1 if enough rows, else R2)."""
    n = int(samples_per_class)
    counts = class_counts(df, label_col, labels)
    keep = {c: n for c, k in counts.items() if k >= n}
    draw = {c: n for c, k in counts.items() if k < n}
    return execute_plan(spark, df, counts, keep, draw, seed=seed, id_cols=id_cols,
                        label_col=label_col, digits=digits, shuffle=shuffle)


def sample_with_replacement(spark: SparkSession, df: DataFrame, n: int, *, seed=42,
                            id_cols=("id",), label_col="label",
                            labels: Sequence[int] = REFERENCE_LABELS,
                            digits: int = DEFAULT_DIGITS) -> DataFrame:
    """R2 per class: exactly ``n`` independent draws from every present class.
    Output adds ``draw`` (0..n-1)."""
    counts = class_counts(df, label_col, labels)
    draw = {c: int(n) for c, k in counts.items() if k > 0}
    out = execute_plan(spark, df, counts, {}, draw, seed=seed, id_cols=id_cols,
                       label_col=label_col, digits=digits, shuffle=False)
    return out.withColumn("draw", F.element_at(F.split("sample_key", ":"), 3).cast("bigint")) \
              .drop("sample_key")


# ---------------------------------------------------------------- R5

def weighted_sample(spark: SparkSession, df: DataFrame, *, seed=42, id_cols=("id",),
                    label_col="label", labels: Sequence[int] | None = None,
                    digits: int = DEFAULT_DIGITS) -> DataFrame:
    """R5 with weight ``1/count(class)``: ``len(df)`` draws with replacement.

    With those weights every present class is equally likely and rows within a
    class are uniform, so draw ``d`` (one per input row, keyed by the row's id)
    picks class ``md5(seed:c:d) mod K`` among present classes, then rank
    ``md5(seed:r:d) mod count + 1`` inside it. Output: ``draw_id`` (the id of
    the row that spawned the draw) + the drawn row's columns. Both join sides
    grow with the data; their key ``(label, rank)`` is uniform, so not hot. Only
    ids are ranked; the other columns join the drawn ids once. A null label
    raises; with ``labels`` rows of other classes are left out, otherwise every
    class takes part.
    """
    id_cols = list(id_cols)
    cols = df.columns
    if df.where(F.col(label_col).isNull()).limit(1).count():
        raise ValueError(f"null {label_col}: the sampler weighs every row by its class")
    counts = {c: n for c, n in class_counts(df, label_col, labels).items() if n > 0}
    src = _in_domain(df, label_col, labels)
    ranked = _rank_classes(src.select(label_col, *id_cols), seed, id_cols, label_col, counts, digits)
    # present classes in label order: (index, label, rows), <= one row per class
    classes = spark.createDataFrame([(i, int(c), int(n)) for i, (c, n) in enumerate(counts.items())],
                                    "_class_idx BIGINT, _l BIGINT, _n BIGINT")
    idx = F.pmod(hex_prefix_int(seeded_key(seed, F.lit("c"), "draw_id"), DRAW_DIGITS), F.lit(len(counts)).cast("bigint"))
    draws = (src.select(_id_str(id_cols).alias("draw_id"))
             .withColumn("_class_idx", idx)
             .join(F.broadcast(classes), "_class_idx")
             .select("draw_id", F.col("_l").cast(df.schema[label_col].dataType).alias(label_col),
                     (F.pmod(hex_prefix_int(seeded_key(seed, F.lit("r"), "draw_id"), DRAW_DIGITS), F.col("_n")) + 1)
                     .alias("_rank")))
    drawn = draws.join(ranked, [label_col, "_rank"]).select("draw_id", label_col, *id_cols)
    return src.join(drawn, [label_col, *id_cols]).select("draw_id", *cols)


# ---------------------------------------------------------------- A13 / A14

def balance_report(before: DataFrame, after: DataFrame, label_col: str = "label",
                   labels: Sequence[int] | None = None) -> DataFrame:
    """One row of sizes (every row counted, null labels too), reduction
    percent, both imbalance ratios (present classes only) and, S17, the rows
    the balancing dropped (null label or, with ``labels``, outside the list).
    Both sides are reduced to per-label counts (<= K + 1 rows) before they meet."""
    def counts(df, after_side):
        return (df.groupBy(F.col(label_col).alias("_l")).agg(F.count(F.lit(1)).alias("n"))
                .withColumn("_after", F.lit(after_side)))

    both = counts(before, False).unionByName(counts(after, True))
    known = F.col("_l").isNotNull()
    in_domain = known & F.col("_l").isin([int(x) for x in labels]) if labels is not None else known

    def side(agg, after_side: bool, cond=F.lit(True)):
        return agg(F.when((F.col("_after") == F.lit(after_side)) & cond, F.col("n")))

    return (both.agg(side(F.sum, False).cast("bigint").alias("rows_before"),
                     side(F.sum, True).cast("bigint").alias("rows_after"),
                     (side(F.max, False, known) / side(F.min, False, known)).alias("imbalance_before"),
                     (side(F.max, True, known) / side(F.min, True, known)).alias("imbalance_after"),
                     F.coalesce(side(F.sum, False, ~in_domain), F.lit(0)).cast("bigint").alias("rows_dropped"))
            .withColumn("reduction_pct", 100.0 * (1 - F.col("rows_after") / F.col("rows_before")))
            .select("rows_before", "rows_after", "reduction_pct", "imbalance_before", "imbalance_after",
                    "rows_dropped"))


# The printed size summary of a balancing run.
SUMMARY_LINES = ("Original size: ", "Balanced size: ", "Reduction: ")


def balance_summary_lines(report: DataFrame) -> DataFrame:
    """F4 over A13: thousands-separated sizes and the one-decimal reduction, as
    (line, value) rows."""
    a, b, c = SUMMARY_LINES
    lines = F.array(
        F.struct(F.lit(1).alias("line"), F.concat(F.lit(a), F.format_number("rows_before", 0)).alias("value")),
        F.struct(F.lit(2).alias("line"), F.concat(F.lit(b), F.format_number("rows_after", 0)).alias("value")),
        F.struct(F.lit(3).alias("line"),
                 F.concat(F.lit(c), F.format_string("%.1f%%", "reduction_pct")).alias("value")))
    return report.select(F.explode(lines).alias("r")).select("r.*")


# The printed per-class lines of a balancing run, by action.
AUDIT_UNDERSAMPLED = "Undersampling: %d -> %d samples"
AUDIT_OVERSAMPLED = "Label %d (%-15s): %6d -> %6d (oversampled)"
AUDIT_KEPT = "Label %d (%-15s): %6d samples (kept all)"


def balance_audit_lines(spark: SparkSession, audit: DataFrame, labels: Sequence[int],
                        names: Sequence[str], label_col: str = "label") -> DataFrame:
    """F4 over A14: one text line per class of the audit, (label, value)."""
    from labelscope.functions.labels import label_dimension

    j = audit.join(F.broadcast(label_dimension(spark, labels, names)
                               .withColumnRenamed("label", label_col)), label_col, "left")
    line = (F.when(F.col("action") == "undersampled",
                   F.format_string(AUDIT_UNDERSAMPLED, "n_before", "n_after"))
            .when(F.col("action") == "oversampled",
                  F.format_string(AUDIT_OVERSAMPLED, label_col, "name", "n_before", "n_after"))
            .otherwise(F.format_string(AUDIT_KEPT, label_col, "name", "n_before")))
    return j.select(F.col(label_col).alias("label"), line.alias("value"))


def balance_audit(before: DataFrame, after: DataFrame, label_col: str = "label") -> DataFrame:
    """Per class original count, new count and action."""
    b = label_counts(before, label_col).withColumnRenamed("count", "n_before")
    a = label_counts(after, label_col).withColumnRenamed("count", "n_after")
    j = b.join(a, "label", "full_outer").select(
        F.col("label").alias(label_col), F.coalesce("n_before", F.lit(0)).cast("bigint").alias("n_before"),
        F.coalesce("n_after", F.lit(0)).cast("bigint").alias("n_after"))
    action = (F.when(F.col("n_after") < F.col("n_before"), "undersampled")
              .when(F.col("n_after") > F.col("n_before"), "oversampled").otherwise("kept"))
    return j.withColumn("action", action)
