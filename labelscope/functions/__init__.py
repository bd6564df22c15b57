"""Column expressions (JVM-side, codegen friendly)."""

from labelscope.functions.arrays import argmax, log_softmax_at, logsumexp
from labelscope.functions.hashing import seeded_key, hex_prefix_int, bucket_of
from labelscope.functions.labels import LABEL_NAMES, label_dimension, label_grid
from labelscope.functions.text import metadata_prefix, tokens, as_text

__all__ = [
    "argmax", "log_softmax_at", "logsumexp",
    "seeded_key", "hex_prefix_int", "bucket_of",
    "LABEL_NAMES", "label_dimension", "label_grid",
    "metadata_prefix", "tokens", "as_text",
]
