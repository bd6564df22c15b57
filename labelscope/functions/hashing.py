"""Seeded hashing that agrees bit for bit with DuckDB's ``md5``.

A row's random key is ``md5('<seed>:<id>')``. Ordering by the key is a
seeded random permutation; its leading hex digits form a bucket, so ordering
by key orders by bucket first (the basis of the bucketed rank).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed, *parts) -> Column:
    cols = [F.lit(str(seed))] + [
        (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def hex_prefix_int(hex_col, digits: int = 8) -> Column:
    """Leading ``digits`` hex characters as a non-negative BIGINT."""
    c = F.col(hex_col) if isinstance(hex_col, str) else hex_col
    return F.conv(F.substring(c, 1, digits), 16, 10).cast("bigint")


def bucket_of(hex_col, digits: int) -> Column:
    return hex_prefix_int(hex_col, digits).cast("int")
