"""URL filter: host/path rules, then a list of canonical URLs behind a blocked
Bloom filter.

The listed URLs are hashed into a split-block Bloom filter: a URL picks one
512-bit block and one bit in each of the block's eight 64-bit words. The
filter is a table ``(block, w0..w7)`` built by ``bit_or``; it grows with the
list (``BITS_PER_URL`` bits a URL) and is broadcast only when its computed
size is at most ``BROADCAST_BYTES``, else joined by block. Possible hits then
meet the list in an exact join, which removes false positives. Only DataFrame
functions are used.

Defined results: a null URL, or one without ``://``, has empty host and path
and an empty canonical form, which is never listed; repeated rows are judged
one by one; repeated or null listed URLs count once or not at all; an empty
list blocks nothing; extra columns pass through unless named like a result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm._io import stage_table

BITS_PER_URL = 16
BLOCK_BITS = 512
WORDS = 8
#: The filter (72 bytes a block row) is broadcast up to this size.
BROADCAST_BYTES = 32 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
_QUERY = r"(?s)^[^?#]*\?([^#]*)"
#: Query parameters that do not name another page.
_TRACKING = r"^(utm_[a-z]*|ref)(=|$)"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _HOST, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes, and the sorted
    query without tracking parameters; no scheme, no fragment."""
    params = F.array_sort(F.filter(F.split(F.regexp_extract(url, _QUERY, 1), "&"),
                                   lambda p: (p != "") & ~p.rlike(_TRACKING)))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit(""))
    bare = F.regexp_replace(host(url), r"^www\.", "")
    return F.coalesce(F.when(host(url) != "", F.concat(bare, F.regexp_replace(path(url), "/+$", ""), query)), F.lit(""))


def rule_columns(host_col: Column, path_col: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """``(rule, action)`` of the longest fitting rule; rules are
    ``(action, host, path)`` literals."""
    rule = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks).cast("long"))


def _bit(url: Column, i: int) -> Column:
    """The one bit of word ``i``: six bits of a second hash choose it."""
    six = F.shiftrightunsigned(F.xxhash64(F.lit("bit"), url), 6 * i).bitwiseAND(F.lit(63).cast("long"))
    return F.call_function("shiftleft", F.lit(1).cast("long"), six.cast("int"))


def bloom_table(listed: DataFrame, blocks: int, col: str = "canonical") -> DataFrame:
    u = F.col(col)
    return (listed.select(_block(u, blocks).alias("block"), *(_bit(u, i).alias(f"w{i}") for i in range(WORDS)))
            .groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS))))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = (),
                url_col: str = "url", listed_col: str = "url", carry: list[str] | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``: the longest
    fitting rule decides, else a URL on the list is blocked."""
    names = ["host", "path", "rule", "verdict"]
    carry = [c for c in (pages.columns if carry is None else carry) if c not in names]
    urls = stage_table(listed.select(canonical(F.col(listed_col)).alias("canonical"))
                       .where(F.col("canonical") != "").distinct(), "url-list")
    n = urls.count()
    blocks = max(1, math.ceil(n * BITS_PER_URL / BLOCK_BITS))
    bloom = bloom_table(urls, blocks)
    bloom = bloom.toDF(*(f"__f_{c}" for c in bloom.columns))
    if blocks * 72 <= BROADCAST_BYTES:
        bloom = F.broadcast(bloom)
    src = pages.select(*carry, F.col(url_col).alias("__url"))
    src = src.select(*carry, host(F.col("__url")).alias("host"), path(F.col("__url")).alias("path"),
                     canonical(F.col("__url")).alias("__canonical"))
    rule, action = rule_columns(F.col("host"), F.col("path"), rules)
    src = src.withColumns({"rule": rule, "__action": action})
    c = F.col("__canonical")
    probe = src.withColumn("__block", _block(c, blocks))
    probe = probe.join(bloom, F.col("__block") == F.col("__f_block"), "left")
    in_filter = F.lit(True)
    for i in range(WORDS):
        in_filter = in_filter & (F.col(f"__f_w{i}").bitwiseAND(_bit(c, i)) == _bit(c, i))
    possible = F.coalesce(in_filter & F.col("__action").isNull() & (c != ""), F.lit(False))
    # rows that cannot be hits get spread keys no URL equals, so they neither
    # match nor gather in one partition
    key = F.when(possible, c).otherwise(F.concat(F.lit(" "), F.xxhash64(c, *carry).cast("string")))
    probe = probe.select(*carry, "host", "path", "rule", "__action", key.alias("__key"))
    exact = urls.select(F.col("canonical").alias("__listed"))
    out = probe.join(exact, F.col("__key") == F.col("__listed"), "left")
    verdict = F.coalesce(F.col("__action"), F.when(F.col("__listed").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(*carry, "host", "path", "rule", verdict.alias("verdict"))
