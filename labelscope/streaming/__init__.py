"""Stateless row operators on streaming DataFrames.

The reference has no streams (every input is a finite file). The row-level
operators (argmax, correctness flag, per-row losses, metadata prefix) are
plain column expressions, so they apply to a ``readStream`` DataFrame
unchanged; ``score_stream`` wires them for a stream of scored rows.
"""

from labelscope.streaming.scoring import score_stream

__all__ = ["score_stream"]
