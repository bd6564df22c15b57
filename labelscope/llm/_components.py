"""Connected components of a large edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm._io import stage_table


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has an edge to another node; ``root``
    is the smallest node of its component.

    Large-star and small-star steps in turn (each links a node's neighbours to
    the smallest of them) until the edges no longer change; they are then stars
    around the roots. Minima are pre-aggregated before the shuffle, every round
    is staged in the shared folder, and only a count and a hash of the edge
    table reach the driver."""
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    links = stage_table(links, "edges")
    before = _state(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("x")).agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = (both.where("v > u").join(low, F.col("u") == F.col("x"))
                 .select(F.col("v").alias("u"), F.col("low").alias("v")).distinct())
        large = stage_table(large, "large-star")
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("low"))
        moved = large.join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = moved.unionByName(low.select(F.col("x").alias("u"), F.col("low").alias("v"))).where("u > v").distinct()
        links = stage_table(small, "small-star")
        after = _state(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
