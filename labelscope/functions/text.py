"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace split pattern and metadata prefix format.
TOKEN_SPLIT = "[ \t\r\n]+"
META_PREFIX = "# Language: "


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(c, null_as: str = "") -> Column:
    """String cast; null text becomes ``null_as``."""
    return F.coalesce(_c(c).cast("string"), F.lit(null_as))


def metadata_prefix(code, language=None) -> Column:
    """``# Language: {language}\\n{code}`` when a language column is given (P5)."""
    if language is None:
        return as_text(code)
    return F.concat(F.lit(META_PREFIX), as_text(language), F.lit("\n"), as_text(code))


def tokens(text) -> Column:
    """Whitespace tokens, case kept, empty tokens dropped."""
    return F.array_remove(F.split(as_text(text), TOKEN_SPLIT), "")
