"""Mixing sources to target weights by temperature (DataFrame functions only).

Source shares p of all tokens are raised to an exponent a in [0, 1] and
normalised to weights w. The exponent is bisected to meet a target:

* ``max_repetition``: the flattest mix (smallest a) in which no source is read
  more than that many times;
* ``min_entropy`` (nats): the most natural mix (largest a) whose weights have
  at least that entropy.

The budget is ``budget_tokens`` or, by default, the smallest one that reads
every source at least once, so no document is lost. A source's quota becomes
whole epochs and a rest; the rest is realised as a permutation of the source's
``BLOCKS`` hash blocks: blocks in permuted order while they fit, then, inside
the one block that does not, documents in hash order while they fit. Only
block totals are ordered, so a hot source is never one sorted group, and every
step is a function of ids and totals: recomputed tasks give the same mix.

Defined results: a null source is a source of its own; texts that are null or
empty have 0 tokens and are read as often as their block; sources without
tokens are read once; repeated ids share their block and place and are taken
together; an empty table gives an empty mix; extra columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelscope.llm._io import stage_table

BLOCKS = 4096
BISECTIONS = 30
#: The (source, block) plan is broadcast while it has at most so many rows
#: (under 100 bytes each apart from the source name, which must be short too).
BROADCAST_ROWS = 400_000
BROADCAST_NAME = 200
#: A null source's name; real names get a letter in front, so none can equal it.
_NULL = "0"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _source(col: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), col.cast("string")), F.lit(_NULL))


def _doc_key(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(id_col.cast("string"), F.lit(""))))


def _block(key: Column) -> Column:
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(BLOCKS).cast("long"))


@dataclass
class Mix:
    """A realised mix: the exponent, the budget, and per (source, block) the
    whole epochs, whether the last part takes the block, and the last key it
    takes of a block that fits in part."""

    exponent: float
    budget: float
    weights: DataFrame
    plan: DataFrame
    sized: DataFrame
    seed: int
    small: bool

    def copies(self, docs: DataFrame, source_col: str, id_col: str, name: str = "n_copies") -> DataFrame:
        """``docs`` with how often each row is read."""
        key = _doc_key(F.col(id_col), self.seed)
        rows = docs.withColumns({"__s": _source(F.col(source_col)), "__k": key}).withColumn("__b", _block(F.col("__k")))
        plan = F.broadcast(self.plan) if self.small else self.plan
        rows = rows.join(plan, (F.col("__s") == F.col("__ps")) & (F.col("__b") == F.col("__pb")), "left")
        extra = F.coalesce(F.col("__whole") | (F.col("__k") <= F.col("__cut")), F.lit(False))
        n = (F.coalesce(F.col("__epochs"), F.lit(1)) + extra.cast("long")).cast("long")
        return rows.withColumn(name, n).drop("__s", "__k", "__b", "__ps", "__pb", "__epochs", "__whole", "__cut")


def _bisect(shares: DataFrame, holds, keep_high: bool) -> float:
    """Exponent at the border of ``holds`` in [0, 1]; only aggregates of the
    share table, two numbers a step, reach the driver."""
    if holds(shares, 0.0 if keep_high else 1.0):
        return 0.0 if keep_high else 1.0
    lo, hi = 0.0, 1.0
    for _ in range(BISECTIONS):
        mid = (lo + hi) / 2
        if holds(shares, mid) == keep_high:
            hi = mid
        else:
            lo = mid
    # six decimals, rounded to the side that meets the target
    return math.ceil(hi * 1e6) / 1e6 if keep_high else math.floor(lo * 1e6) / 1e6


def _repetition_holds(limit: float, budget: float | None):
    def holds(shares: DataFrame, a: float) -> bool:
        power = F.exp(F.lit(a) * F.ln("p"))
        r = shares.agg(F.sum(power).alias("z"), F.max(power / F.col("tokens")).alias("top"),
                       F.min(power / F.col("tokens")).alias("low")).first()
        # reads of a source: budget * w / tokens; by default the least is 1
        most = r["top"] / r["low"] if budget is None else budget * r["top"] / r["z"]
        return most <= limit * (1 + 1e-12)
    return holds


def _entropy_holds(least: float):
    def holds(shares: DataFrame, a: float) -> bool:
        x = F.lit(a) * F.ln("p")
        r = shares.agg(F.sum(F.exp(x)).alias("z"), F.sum(F.exp(x) * x).alias("s")).first()
        return math.log(r["z"]) - r["s"] / r["z"] >= least - 1e-12
    return holds


def temperature_mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id",
                    tokens: Column | None = None, max_repetition: float | None = None,
                    min_entropy: float | None = None, budget_tokens: int | None = None,
                    seed: int = 42) -> Mix:
    if (max_repetition is None) == (min_entropy is None):
        raise ValueError("give max_repetition or min_entropy")
    tokens = word_count(F.col("text")) if tokens is None else tokens
    key = _doc_key(F.col(id_col), seed)
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _source(F.col(source_col)).alias("s"),
                        key.alias("k"), tokens.alias("n_tokens")).withColumn("b", _block(F.col("k")))
    sized = stage_table(sized, "mix-sized")
    blocks = stage_table(sized.groupBy("s", "b").agg(F.sum("n_tokens").alias("n")), "mix-blocks")
    totals = blocks.groupBy("s").agg(F.sum("n").alias("tokens")).where("tokens > 0")
    whole = totals.agg(F.sum("tokens")).first()[0]
    shares = stage_table(totals.withColumn("p", F.col("tokens") / F.lit(float(whole or 1))), "mix-shares")
    exponent, budget = 1.0, 0.0
    if whole:
        if max_repetition is not None:
            exponent = _bisect(shares, _repetition_holds(max_repetition, budget_tokens), True)
        else:
            exponent = _bisect(shares, _entropy_holds(min_entropy), False)
    power = F.exp(F.lit(exponent) * F.ln("p"))
    r = shares.agg(F.sum(power).alias("z"), F.count("*").alias("n"), F.max(F.length("s")).alias("name")).first()
    weights = shares.withColumn("weight", power / F.lit(r["z"] or 1.0))
    if whole:
        budget = float(budget_tokens) if budget_tokens is not None else weights.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0]
    quota = F.round(F.lit(budget) * F.col("weight")).cast("long")
    weights = (weights.withColumn("quota", quota).withColumn("epochs", F.expr("quota div tokens"))
               .withColumn("rest", F.col("quota") - F.col("epochs") * F.col("tokens")))
    small = r["n"] * BLOCKS <= BROADCAST_ROWS and (r["name"] or 0) <= BROADCAST_NAME

    ordered = blocks.join(F.broadcast(weights) if small else weights, "s")
    place = F.md5(F.concat(F.lit(f"{seed}|block|"), F.col("b").cast("string"), F.lit("|"), F.col("epochs").cast("string")))
    w = Window.partitionBy("s").orderBy("place", "b")
    ordered = (ordered.withColumn("place", place).withColumn("upto", F.sum("n").over(w))
               .withColumn("left", F.col("rest") - F.col("upto") + F.col("n")))
    ordered = stage_table(ordered.select("s", "b", "n", "epochs", "left"), "mix-order")
    parts = ordered.where("left > 0 and left < n").select("s", "b", "left")
    inner = Window.partitionBy("s", "b").orderBy("k")  # equal keys are one step: a RANGE frame
    cuts = (sized.join(F.broadcast(parts) if small else parts, ["s", "b"])
            .withColumn("upto", F.sum("n_tokens").over(inner)).where("upto <= left")
            .groupBy("s", "b").agg(F.max("k").alias("cut")))
    plan = ordered.join(cuts, ["s", "b"], "left").select(
        F.col("s").alias("__ps"), F.col("b").alias("__pb"), F.col("epochs").alias("__epochs"),
        ((F.col("left") >= F.col("n")) & (F.col("left") > 0)).alias("__whole"), F.col("cut").alias("__cut"))
    return Mix(exponent, budget, weights, stage_table(plan, "mix-plan"), sized, seed, small)


def realise(docs: DataFrame, mix: Mix, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Each row of ``docs`` as often as the mix reads it."""
    n = "__mix_copies"
    rows = mix.copies(docs, source_col, id_col, n).where(F.col(n) > 0)
    return (rows.withColumn("__mix_read", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
            .drop(n, "__mix_read"))
