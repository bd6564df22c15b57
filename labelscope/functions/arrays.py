"""Array expressions over logits and token ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def argmax(logits) -> Column:
    """0-based index of the largest element; lowest index on a tie (M9)."""
    z = _c(logits)
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def logsumexp(logits) -> Column:
    """Numerically stable log(sum(exp(z)))."""
    z = _c(logits)
    m = F.array_max(z)
    s = F.aggregate(F.transform(z, lambda x: F.exp(x - m)), F.lit(0.0).cast("double"),
                    lambda acc, x: acc + x)
    return m + F.log(s)


def log_softmax_at(logits, index) -> Column:
    """log p_index for a 0-based index column."""
    z = _c(logits)
    return F.element_at(z, _c(index) + 1) - logsumexp(z)
