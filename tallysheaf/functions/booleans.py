"""Reading booleans: four pairs, never mixed within a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pattern -> (word for true, word for false, whether case is ignored).
PAIRS = {
    "true/false": ("true", "false", True),
    "wahr/falsch": ("wahr", "falsch", True),
    "ja/nein": ("ja", "nein", True),
    "1/0": ("1", "0", False),
}
PAIR_KEYS = tuple(PAIRS)


def parse_boolean(text: Column, pair: str) -> Column:
    yes, no, fold = PAIRS[pair]
    word = F.lower(text) if fold else text
    return F.when(word == yes, F.lit(True)).when(word == no, F.lit(False))


def reads_as_boolean(text: Column, pair: str) -> Column:
    yes, no, fold = PAIRS[pair]
    return (F.lower(text) if fold else text).isin(yes, no)
