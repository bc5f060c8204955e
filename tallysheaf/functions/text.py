"""Trimming and emptiness, with the whitespace a report export actually contains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as whitespace at the edge of a cell. Spark's own trim knows only U+0020.
WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# What a column reads as missing until the user says otherwise; compared after trimming, exact case.
DEFAULT_MISSING = ("", "-", "–", "—", "n/a", "N/A", "k.A.", "k. A.")


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """NULL, empty, or whitespace only."""
    return text.isNull() | (trimmed(text) == "")


def is_missing(trimmed_text: Column, tokens=DEFAULT_MISSING) -> Column:
    """True for a missing token; a NULL cell reads as the empty text."""
    if not tokens:
        return F.lit(False)
    return F.coalesce(trimmed_text.isin(list(tokens)), F.lit("" in tokens))
