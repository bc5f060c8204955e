"""Global positions: every row's number in the order in force, without any task holding more than its share.

Rows are split by ranges of the order keys and sorted within; the rows a range has before it are the sum of the counts
of the ranges before. The sorted rows are written once, since a second sort would draw other ranges, and counting then
reads no more than their numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import report as R
from ..plans.storage import stored
from ..table import ORDER_PREFIX, OrderKey, Table, col

#: Rows up to which a top-N is a task's matter; more are taken by their positions.
TOP_N = 100_000

RANK = f"{ORDER_PREFIX}r"
_PART, _AT = "__part", "__at"


def positions(df: DataFrame, keys: list[Column], keep: list[Column], name: str = RANK) -> DataFrame:
    """``keep`` of every row and ``name``, its position from 0 in the order of ``keys``. Runs the sort.

    Keys that end in a row's place in its source are all different, so that a value many rows share is still split.
    """
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        *keep, F.spark_partition_id().alias(_PART), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(_AT))
    written = stored(placed, "positions")
    counts = written.groupBy(_PART).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # One row per partition of the sort: as many as its tasks, whatever the table.
    offsets = counts.select(_PART, before.alias("__before"))
    ranked = written.join(F.broadcast(offsets), _PART)
    return ranked.withColumn(name, F.col("__before") + F.col(_AT)).drop(_PART, _AT, "__before")


def ranked(table: Table) -> Table:
    """The same rows in the same order, which is now one number: the row's position from 0."""
    if not table.order:
        R.refuse_if([R.error(R.CONFIG_INVALID, field="order", value="the table has no order to rank")])
    keep = [x for c in table.cols for x in (col(c.name), *map(col, c.hidden))]
    df = positions(table.df, [k.asc() for k in table.order], keep)
    return table.with_df(df, order=(OrderKey(RANK),))


def with_rank(table: Table, name: str = "rank") -> DataFrame:
    """Every row with its position from 1 in the order in force."""
    R.refuse_if([R.error(R.RENAME_COLLISION, name=name)] if table.has(name) else [])
    out = ranked(table)
    return out.df.select(*[col(c.name) for c in out.cols], (col(RANK) + 1).alias(name))
