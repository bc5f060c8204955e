"""Put rows in order. A sort refines the order already in force, so ties keep the order they arrived in."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import report as R
from ..functions.text import is_blank
from ..table import ORDER_PREFIX, TEXT, Col, OrderKey, Table, col

DIRECTIONS = ("asc", "desc")
COLLATION = "de"


def default_config() -> dict:
    return {"keys": []}


def _pairs(keys) -> list[tuple]:
    return [
        (k.get("column"), "asc" if k.get("direction") is None else k.get("direction"))
        if isinstance(k, dict) else (None, "asc")
        for k in keys
    ]


def validate(config) -> list[R.Diagnostic]:
    if not isinstance(config, dict):
        return [R.error(R.CONFIG_INVALID, field="config")]
    if not isinstance(config.get("keys"), list):
        return [R.error(R.CONFIG_INVALID, field="keys")]
    out, taken = [], set()
    for at, (column, direction) in enumerate(_pairs(config["keys"])):
        if not isinstance(column, str) or column == "":
            out.append(R.error(R.CONFIG_INVALID, field="key", at=at))
            continue
        if column in taken:
            out.append(R.error(R.SORT_KEY_REPEATED, column=column, at=at))
        taken.add(column)
        if direction not in DIRECTIONS:
            out.append(R.error(R.CONFIG_INVALID, field="direction", at=at, value=str(direction)))
    return out


def _unordered(c: Col, data_type: T.DataType) -> Column:
    """Empty, boxed and not-a-number cells: last in either direction."""
    cell = col(c.name)
    if c.kind == TEXT:
        return is_blank(cell)
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return cell.isNull() | F.isnan(cell)
    return cell.isNull()


def sort_rows(table: Table, keys: list[dict], report: R.Report | None = None) -> Table:
    """Stable sort by one or more columns; text by German collation, everything else by value.

    Nothing is sorted here: the keys are added to the order in force, and the one global sort happens where the
    order is consumed. Per key a flag sends empty and unreadable cells last in both directions, and the value is
    NULL beside it so that later keys still decide among those rows.
    """
    R.refuse_if(validate({"keys": keys}))
    pairs = _pairs(keys)
    if not pairs:
        return table
    R.refuse_if([R.error(R.UNKNOWN_COLUMN, column=name) for name, _ in pairs if not table.has(name)])

    types = {f.name: f.dataType for f in table.df.schema.fields}
    added, order = [], []
    start = len(table.order)
    for at, (name, direction) in enumerate(pairs):
        c = table[name]
        last = _unordered(c, types[name])
        cell = F.collate(col(name), COLLATION) if c.kind == TEXT else col(name)
        flag, value = (f"{ORDER_PREFIX}s{start}_{at}{part}" for part in ("f", "v"))
        added += [last.cast("tinyint").alias(flag), F.when(~last, cell).alias(value)]
        order += [OrderKey(flag), OrderKey(value, direction == "desc")]
        if c.nanos:
            added.append(F.when(~last, col(c.nanos)).alias(f"{ORDER_PREFIX}s{start}_{at}n"))
            order.append(OrderKey(f"{ORDER_PREFIX}s{start}_{at}n", direction == "desc"))

    raws = [table[name].raw for name, _ in pairs if table[name].raw]
    if report is not None and raws:
        boxed = reduce(or_, (col(r).isNotNull() for r in raws))
        table, _, seen = report.tally(table, boxed=boxed)
        report.later(
            lambda: [R.warning(R.BOXED_ROWS_LAST, rows=seen()["boxed"])] if seen()["boxed"] else []
        )
    return table.extended(added, order=tuple(order) + table.order)


def apply(inputs: list[Table], config: dict, report: R.Report | None = None) -> Table:
    return sort_rows(inputs[0], config.get("keys", []), report)
