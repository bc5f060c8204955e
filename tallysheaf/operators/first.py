"""The first or last N rows of the order in force."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import report as R
from ..table import Table, col
from .rank import RANK, TOP_N, ranked

ENDS = ("first", "last")


def default_config() -> dict:
    return {"count": None, "end": "first"}


def validate(config) -> list[R.Diagnostic]:
    if not isinstance(config, dict):
        return [R.error(R.CONFIG_INVALID, field="config")]
    out = []
    if config.get("end", "first") not in ENDS:
        out.append(R.error(R.CONFIG_INVALID, field="end", value=str(config.get("end"))))
    count = config.get("count")
    if count is not None and (isinstance(count, bool) or not isinstance(count, int) or count < 1):
        out.append(R.error(R.CONFIG_INVALID, field="count", value=str(count)))
    return out


def first_rows(table: Table, count: int | None, end: str = "first", report: R.Report | None = None) -> Table:
    """``count`` rows from either end; ``None`` or a count past the table keeps everything.

    A sort directly under a limit is one top-N pass: each task keeps ``count`` rows, no global sort happens. The
    last N are the first N of the reversed order, and keep their forward order since the order keys ride along. More
    than ``TOP_N`` rows are more than one task should hold: they are taken by their positions, which sorts the table
    now, in ranges, and writes it.
    """
    R.refuse_if(validate({"count": count, "end": end}))
    if count is None:
        return table
    if not table.order:
        R.refuse_if([R.error(R.CONFIG_INVALID, field="order", value="the table has no order to take rows from")])
    if count > TOP_N:
        whole = ranked(table)
        within = F.col(RANK) < count if end == "first" else F.col(RANK) >= whole.df.count() - count
        taken = whole.with_df(whole.df.where(within))
    else:
        keys = [k.asc() if end == "first" else k.reverse() for k in table.order]
        taken = table.with_df(table.df.orderBy(*keys).limit(count))
    if report is not None:
        table, _, seen = report.tally(table, rows=F.lit(True))
        report.close(table)
        held = None
        if any(c.raw for c in table.cols):
            taken, _, held = report.tally(taken, boxed=table.any_box())

        def counts():
            rows = seen()["rows"]
            out = [R.info(R.ROWS_REMOVED, removed=rows - min(rows, count), kept=min(rows, count))]
            if held is not None and held()["boxed"]:
                out.append(R.warning(R.BOXED_ROWS_KEPT, rows=held()["boxed"]))
            return out

        report.later(counts)
    return taken


def row_window(table: Table, start: int, count: int):
    """Rows ``start`` to ``start + count`` of the order in force, beside the whole table's counts.

    Returns (frame of the window, frame of one row: ``rows``, ``columns``). A window that ends past ``TOP_N`` rows is
    taken by positions, so that no task has to hold what lies before it.
    """
    if start + count > TOP_N:
        whole = ranked(table)
        window = whole.df.where((F.col(RANK) >= start) & (F.col(RANK) < start + count)).orderBy(RANK)
    else:
        window = table.df.orderBy(*[k.asc() for k in table.order]).offset(start).limit(count)
    total = table.df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(table.cols)))
    return window.select(*[col(c.name) for c in table.cols]), total


def preview(table: Table, limit: int = 50):
    """The head of the table and the counts of the whole table."""
    return row_window(table, 0, limit)


def apply(inputs: list[Table], config: dict, report: R.Report | None = None) -> Table:
    return first_rows(inputs[0], config.get("count"), config.get("end", "first"), report)
