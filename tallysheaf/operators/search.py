"""Find text anywhere in a table: every row, every column, as the cells read on screen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import report as R
from ..functions.render import cell_text
from ..table import Table, col
from .rank import RANK, positions


def search(table: Table, text: str) -> Table:
    """The rows with a cell containing ``text``, in order, with ``matched_columns`` naming where it was found."""
    hits = F.array_compact(F.array(*[
        F.when(cell_text(c).contains(text), F.lit(c.name)) for c in table.cols
    ]))
    df = table.df.withColumn("matched_columns", hits).where(F.size("matched_columns") > 0)
    return table.with_df(df)


def search_counts(table: Table, text: str) -> DataFrame:
    """How many rows and how many cells match: one row, ``rows`` and ``cells``."""
    found = search(table, text).df
    return found.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.size("matched_columns")), F.lit(0)).cast("bigint").alias("cells"),
    )


def search_positions(table: Table, text: str) -> DataFrame:
    """Where ``text`` stands: one row per matching cell, ``hit`` (from 1, by row, then column), ``row`` (from 1, in the order
    in force), ``place`` (of the column, from 1) and ``column``.

    Rows are numbered from their order keys and a list of hit columns alone, so cells are read once and never moved.
    Hits are numbered by row and place; a row has at most as many as the table has columns.
    """
    if not table.order:
        R.refuse_if([R.error(R.CONFIG_INVALID, field="order", value="the table has no order to count rows in")])
    found = F.array_compact(F.array(*[F.when(cell_text(c).contains(text), F.lit(i)) for i, c in enumerate(table.cols)]))
    thin = table.df.select(*[col(k.name) for k in table.order], found.alias("__found"))
    rows = positions(thin, [k.asc() for k in table.order], [F.col("__found")]).where(F.size("__found") > 0)
    hits = rows.select((F.col(RANK) + 1).alias("row"), F.explode("__found").alias("place"))
    numbered = positions(hits, [F.col("row"), F.col("place")], [F.col("row"), F.col("place")], "hit")
    names = F.array(*[F.lit(c.name) for c in table.cols])
    return numbered.select((F.col("hit") + 1).alias("hit"), "row", (F.col("place") + 1).cast("int").alias("place"), F.get(names, F.col("place")).alias("column"))
