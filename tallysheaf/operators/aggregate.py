"""Group rows and summarise each group. Missing keys form a group of their own; boxes are skipped and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import report as R
from ..table import NANOS_SUFFIX, NUMBER, ORDER_PREFIX, Col, OrderKey, Table, col, free_name, nanos_of

OPERATIONS = ("count", "count_distinct", "sum", "average", "minimum", "maximum")
_NUMERIC_ONLY = ("sum", "average")


def default_config() -> dict:
    return {"by": [], "aggs": [{"op": "count", "as": "count"}]}


def validate(config) -> list[R.Diagnostic]:
    if not isinstance(config, dict):
        return [R.error(R.CONFIG_INVALID, field="config")]
    out, by, aggs = [], config.get("by"), config.get("aggs")
    if not isinstance(by, list) or any(not isinstance(n, str) or n == "" for n in by):
        out.append(R.error(R.CONFIG_INVALID, field="by"))
    if not isinstance(aggs, list) or not aggs:
        return [*out, R.error(R.CONFIG_INVALID, field="aggs")]
    taken = set(by) if isinstance(by, list) else set()
    for at, agg in enumerate(aggs):
        if not isinstance(agg, dict) or agg.get("op") not in OPERATIONS:
            out.append(R.error(R.CONFIG_INVALID, field="op", at=at))
            continue
        if agg["op"] != "count" and not (isinstance(agg.get("column"), str) and agg["column"]):
            out.append(R.error(R.CONFIG_INVALID, field="column", at=at))
            continue
        name = output_name(agg)
        if name in taken:
            out.append(R.error(R.RENAME_COLLISION, name=name, at=at))
        taken.add(name)
    return out


def output_name(agg: dict) -> str:
    return agg.get("as") or (f"{agg['op']}_{agg['column']}" if agg.get("column") else agg["op"])


def _expression(agg: dict, table: Table) -> Column:
    # A box is NULL in its column, so every aggregate but the row count passes over it.
    op = agg["op"]
    if op == "count":
        return F.count(F.lit(1))
    c = table[agg["column"]]
    cell = col(c.name)
    if op == "count_distinct":
        return F.count_distinct(cell, *[col(n) for n in [c.nanos] if n])
    if c.nanos:
        # The least and the greatest of both parts as one value.
        cell = F.when(cell.isNotNull(), F.struct(cell.alias("cell"), col(c.nanos).alias("nanos")))
    return {"sum": F.sum, "average": F.avg, "minimum": F.min, "maximum": F.max}[op](cell)


def aggregate(table: Table, by: list[str], aggs: list[dict], report: R.Report | None = None) -> Table:
    """One row per group. ``aggs`` is ``[{"op", "column", "as"}]``; without ``by`` the whole table is one group.

    Distinct counts are exact and over present, readable values. The result is ordered by its group keys, which
    identify its rows.
    """
    R.refuse_if(validate({"by": by, "aggs": aggs}))
    used = [a["column"] for a in aggs if a.get("column") and a["op"] != "count"]
    faults = [R.error(R.UNKNOWN_COLUMN, column=n) for n in [*by, *used] if not table.has(n)]
    faults += [
        R.error(R.TYPE_MISMATCH, column=a["column"], columnType=table[a["column"]].kind, valueType=NUMBER)
        for a in aggs
        if a["op"] in _NUMERIC_ONLY and table.has(a["column"]) and table[a["column"]].kind != NUMBER
    ]
    R.refuse_if(faults)

    boxed = sorted({n for n in used if table[n].raw})
    # As a key, each original text of a box is a group of its own, and so are a datetime's nanoseconds.
    taken = {*by, *(output_name(a) for a in aggs)}
    carried = [table[n].renamed(n, taken) for n in by]
    cells, cols = [x for cells, _ in carried for x in cells], [c for _, c in carried]
    keys = [x for c in cols for x in (c.name, *c.hidden)]
    grouped = table.df.groupBy(*cells).agg(*[_expression(a, table).alias(output_name(a)) for a in aggs])
    if report is not None:
        table, _, seen = report.tally(table, rows=F.lit(True), **{f"b{i}": table[n].boxed for i, n in enumerate(boxed)})
        report.close(table)

        def counts():
            found = [R.info(R.AGGREGATE_ROWS, before=seen()["rows"], after=made()["rows"])]
            skipped = {n: seen()[f"b{i}"] for i, n in enumerate(boxed) if seen()[f"b{i}"]}
            if skipped:
                found.append(R.warning(R.AGGREGATE_BOXES, columns=skipped))
            return found

        report.later(counts)

    out = []
    for a in aggs:
        name, extreme = output_name(a), a["op"] in ("minimum", "maximum")
        kind = table[a["column"]].kind if extreme else NUMBER
        affix = table[a["column"]].affix if a["op"] not in ("count", "count_distinct") else None
        nanos = free_name(name + NANOS_SUFFIX, taken) if extreme and table[a["column"]].nanos else None
        out += [col(name)["cell"].alias(name), nanos_of(col(name)["nanos"], name, nanos)] if nanos else [col(name)]
        cols.append(Col(name, kind, None, affix, nanos))
    grouped = grouped.select(*[col(k) for k in keys], *out)
    order = tuple(OrderKey(f"{ORDER_PREFIX}g{i}") for i in range(max(len(keys), 1)))
    hidden = [col(k).alias(o.name) for k, o in zip(keys, order)] or [F.lit(0).alias(order[0].name)]
    result = Table(grouped.select("*", *hidden), tuple(cols), order)
    if report is not None:
        result, _, made = report.tally(result, rows=F.lit(True))
    return result


def apply(inputs: list[Table], config: dict, report: R.Report | None = None) -> Table:
    return aggregate(inputs[0], config.get("by", []), config.get("aggs", []), report)
