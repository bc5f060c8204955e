"""A column profile without cell values, and samples only where they are asked for by name."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import report as R
from ..functions.render import cell_text
from ..plans.session import ship
from ..table import Table, col


def _distinct_values(table: Table, most: int = 200_000) -> DataFrame:
    """Per column its number (``at``) and ``n``, the distinct values that it has: exact, and rows are never multiplied by columns.

    Each task keeps the distinct values of each column and hands them out when it holds ``most`` of them, so a row leaves
    it for each value that it has not met, not for each cell; equal values of tasks are then one. Values travel as text,
    in which no two are alike; a datetime's as its nanoseconds, and of the two zeros there is one.
    """
    ship(table.df.sparkSession)
    cells = []
    for c, f in ((c, table.df.schema[c.name]) for c in table.cols):
        cell = col(c.name)
        if c.nanos:
            cell = F.concat_ws(" ", cell.cast("string"), col(c.nanos).cast("string"))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cell = F.when(cell == 0, F.lit(0.0)).otherwise(cell)
        elif not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType)):
            cell = cell.cast("string")
        cells.append(F.when(col(c.name).isNotNull(), cell).alias(f"c{len(cells)}"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pa.Array] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for at, values in sorted(held.items()):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), at), pa.int32()), values], names=["at", "value"])
            held.clear()

        for batch in batches:
            for at, column in enumerate(batch.columns):
                fresh = pc.cast(pc.drop_null(pc.unique(column)), pa.string())
                held[at] = pc.unique(pa.concat_arrays([held[at], fresh])) if at in held else fresh
            if sum(map(len, held.values())) > most:
                yield from out()
        yield from out()

    found = table.df.select(*cells).mapInArrow(gather, "at int, value string")
    return found.distinct().groupBy("at").agg(F.count(F.lit(1)).alias("n"))


def column_profile(table: Table, source: str, typing=None, approximate: bool = False) -> DataFrame:
    """One row per column: source, rows, column, type, locale, distinct values, null share, note. No cell values.

    Rows and missing cells are one aggregate over one scan; exact distinct counts are taken beside it, with partial sets
    on the tasks. ``approximate`` takes sketches of fixed size instead, in the one aggregate.
    """
    R.refuse_if([] if table.cols else [R.error(R.CONFIG_INVALID, field="columns")])
    stats = []
    for i, c in enumerate(table.cols):
        whole = col(c.name)
        if c.nanos:
            whole = F.when(whole.isNotNull(), F.struct(whole, col(c.nanos)))
        if approximate:
            stats.append(F.approx_count_distinct(whole).alias(f"d{i}"))
        stats.append(R.count_if(col(c.name).isNull() & ~c.boxed).alias(f"m{i}"))
    one = table.df.agg(F.count(F.lit(1)).alias("rows"), *stats)
    records = {c.name: c for c in typing.columns} if typing else {}
    entries = [
        F.struct(
            F.lit(i).alias("at"), F.lit(c.name).alias("column"), F.lit(c.kind).alias("type"),
            F.lit(records[c.name].format if c.name in records else None).cast("string").alias("locale"),
            (F.col(f"d{i}") if approximate else F.lit(0)).cast("bigint").alias("distinct_values"),
            F.try_divide(F.col(f"m{i}"), F.col("rows")).alias("null_share"),
            F.lit(records[c.name].note if c.name in records else "").alias("note"),
        )
        for i, c in enumerate(table.cols)
    ]
    told = one.select(F.lit(source).alias("source"), "rows", F.explode(F.array(*entries)).alias("x")).select("source", "rows", "x.*")
    if not approximate:
        told = told.drop("distinct_values").join(_distinct_values(table), "at", "left").withColumn("distinct_values", F.coalesce("n", F.lit(0)))
    return told.select("source", "rows", "column", "type", "locale", "distinct_values", "null_share", "note")


def sample_values(table: Table, columns: list[str], limit: int = 5) -> DataFrame:
    """Distinct sample values of the named columns as text, at most ``limit`` each. Nothing is sampled by default."""
    R.refuse_if([R.error(R.UNKNOWN_COLUMN, column=n) for n in columns if not table.has(n)])
    R.refuse_if([] if columns else [R.error(R.CONFIG_INVALID, field="columns")])
    picks = [
        table.df.select(F.lit(n).alias("column"), cell_text(table[n]).alias("value")).distinct()
        .orderBy("value").limit(limit)
        for n in columns
    ]
    return reduce(DataFrame.unionByName, picks)
