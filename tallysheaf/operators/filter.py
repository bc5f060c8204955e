"""Keep the rows that meet conditions, and say how many went and how many went because a cell was unreadable."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import report as R
from ..functions.literals import EXPECTED, typed_literal, value_kind
from ..functions.text import is_blank
from ..table import TEMPORAL, TEXT, Table, col

VALUELESS = ("empty", "not_empty")
OPERATORS = ("eq", "ne", "lt", "lte", "gt", "gte", "contains", *VALUELESS)
COMBINES = ("all", "any")


def default_config() -> dict:
    return {"combine": "all", "conditions": []}


def validate(config) -> list[R.Diagnostic]:
    """Every fault of the configuration itself, before any table is looked at."""
    out: list[R.Diagnostic] = []
    if not isinstance(config, dict):
        return [R.error(R.CONFIG_INVALID, field="config")]
    if config.get("combine") not in COMBINES:
        out.append(R.error(R.CONFIG_INVALID, field="combine", value=str(config.get("combine"))))
    conditions = config.get("conditions")
    if not isinstance(conditions, list):
        return [*out, R.error(R.CONFIG_INVALID, field="conditions")]
    for at, condition in enumerate(conditions):
        if not isinstance(condition, dict):
            out.append(R.error(R.CONFIG_INVALID, field="condition", at=at))
            continue
        column, op, value = condition.get("column"), condition.get("op"), condition.get("value")
        if not isinstance(column, str) or column == "":
            out.append(R.error(R.CONFIG_INVALID, field="column", at=at))
        if op not in OPERATORS:
            out.append(R.error(R.CONFIG_INVALID, field="op", at=at, value=str(op)))
        elif (value is not None) if op in VALUELESS else (value_kind(value) is None):
            out.append(R.error(R.CONFIG_INVALID, field="value", at=at, value=str(value)))
    return out


def _disagreements(table: Table, conditions: list[dict]) -> list[R.Diagnostic]:
    """Unknown columns and type clashes, all of them."""
    out = []
    for condition in conditions:
        name, op = condition["column"], condition["op"]
        if not table.has(name):
            out.append(R.error(R.UNKNOWN_COLUMN, column=name))
            continue
        kind = table[name].kind
        if op in VALUELESS:
            continue
        actual = value_kind(condition["value"])
        if actual != EXPECTED[kind] or (op == "contains" and kind != TEXT):
            out.append(R.error(R.TYPE_MISMATCH, column=name, columnType=kind, valueType=actual or "unknown"))
    return out


def _compare(op: str, cell: Column, literal: Column, beyond: int, below: Column | None = None) -> Column:
    """``beyond`` is how many nanoseconds the literal lies past its microsecond, ``below`` how many a cell does.

    Cell and nanoseconds compare as one value, the cell's own bound first so that it reaches the scan.
    """
    if below is not None:
        return {
            "eq": lambda: (cell == literal) & (below == beyond),
            "ne": lambda: (cell != literal) | (below != beyond),
            "lt": lambda: (cell <= literal) & ((cell < literal) | (below < beyond)),
            "lte": lambda: (cell <= literal) & ((cell < literal) | (below <= beyond)),
            "gt": lambda: (cell >= literal) & ((cell > literal) | (below > beyond)),
            "gte": lambda: (cell >= literal) & ((cell > literal) | (below >= beyond)),
        }[op]()
    if beyond:
        if op == "eq":
            return F.lit(False)
        if op == "ne":
            return cell.isNotNull()
        op = "lte" if op in ("lt", "lte") else "gt"
    return {
        "eq": lambda: cell == literal,
        "ne": lambda: cell != literal,
        "lt": lambda: cell < literal,
        "lte": lambda: cell <= literal,
        "gt": lambda: cell > literal,
        "gte": lambda: cell >= literal,
        "contains": lambda: cell.contains(literal),
    }[op]()


def predicate(table: Table, conditions: list[dict], combine: str = "all") -> Column:
    """The conditions as one boolean column. A missing cell matches no comparison, a boxed cell matches nothing.

    Comparisons stay bare ``column <op> literal`` so that they reach the scan.
    """
    faults = _disagreements(table, conditions)
    R.refuse_if(faults)
    terms, unreadable = [], []
    for condition in conditions:
        c, op = table[condition["column"]], condition["op"]
        cell = col(c.name)
        if op in VALUELESS:
            empty = is_blank(cell) if c.kind == TEXT else cell.isNull()
            term = empty if op == "empty" else ~empty
            # A box is NULL in its column, so every comparison already passes over it; emptiness must be told.
            terms.append(term & ~c.boxed if c.raw else term)
            continue
        typed = typed_literal(c.kind, condition["value"])
        if typed is None and c.kind in TEMPORAL:
            unreadable.append(R.error(R.VALUE_UNREADABLE, column=c.name, type=c.kind, value=condition["value"]))
            continue
        terms.append(_compare(op, cell, *typed, col(c.nanos) if c.nanos else None))
    R.refuse_if(unreadable)
    if not terms:
        return F.lit(True)
    return reduce(and_ if combine == "all" else or_, terms)


def _boxed_in(table: Table, conditions: list[dict]) -> Column | None:
    raws = {table[c["column"]].raw for c in conditions if table.has(c["column"])} - {None}
    return reduce(or_, (col(r).isNotNull() for r in sorted(raws))) if raws else None


def filter_rows(
    table: Table, conditions: list[dict], combine: str = "all", report: R.Report | None = None
) -> Table:
    """Rows meeting all (or any) of the conditions; no condition keeps every row."""
    R.refuse_if(validate({"combine": combine, "conditions": conditions}))
    keep = predicate(table, conditions, combine)
    if report is None:
        return table.with_df(table.df.where(keep)) if conditions else table
    boxed = _boxed_in(table, conditions)
    metrics = {"rows": F.lit(True), "kept": keep}
    if boxed is not None:
        metrics["boxed"] = boxed & ~F.coalesce(keep, F.lit(False))
    table, flags, seen = report.tally(table, **metrics)
    report.later(lambda: _counts(seen()["rows"], seen()["kept"], seen().get("boxed", 0)))
    # Rows that go stay on the trail, marked, so that the next step's counts come from the same scan.
    return table.with_df(table.df.where(keep), trail=replace(table.trail, alive=flags["kept"])) if conditions else table


def _counts(rows: int, kept: int, boxed: int) -> list[R.Diagnostic]:
    out = [R.info(R.ROWS_REMOVED, removed=rows - kept, kept=kept)]
    if boxed:
        out.append(R.warning(R.BOXED_ROWS_DROPPED, rows=boxed))
    return out


def filter_counts(table: Table, conditions: list[dict], combine: str = "all") -> DataFrame:
    """The counts alone, as one row: ``removed``, ``kept``, ``boxed_dropped``."""
    keep = F.coalesce(predicate(table, conditions, combine), F.lit(False))
    boxed = _boxed_in(table, conditions)
    dropped = R.count_if(boxed & ~keep) if boxed is not None else F.lit(0).cast("bigint")
    return table.df.agg(
        R.count_if(~keep).alias("removed"), R.count_if(keep).alias("kept"), dropped.alias("boxed_dropped")
    )


def apply(inputs: list[Table], config: dict, report: R.Report | None = None) -> Table:
    return filter_rows(inputs[0], config.get("conditions", []), config.get("combine", "all"), report)
