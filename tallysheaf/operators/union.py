"""Stack tables by column name, after mapping the names that differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import report as R
from ..table import NANOS_SUFFIX, ORDER_PREFIX, RAW_SUFFIX, Col, OrderKey, Table, box_of, col, free_name, nanos_of

UNMATCHED = ("keep", "drop")


def default_config() -> dict:
    return {"mappings": [], "unmatched": "keep"}


def validate(config) -> list[R.Diagnostic]:
    if not isinstance(config, dict):
        return [R.error(R.CONFIG_INVALID, field="config")]
    out = []
    mappings = config.get("mappings", [])
    if not isinstance(mappings, list):
        out.append(R.error(R.CONFIG_INVALID, field="mappings"))
    else:
        for at, m in enumerate(mappings):
            for side in ("target", "from"):
                name = m.get(side) if isinstance(m, dict) else None
                if not isinstance(name, str) or name == "":
                    out.append(R.error(R.CONFIG_INVALID, field=side, at=at))
    unmatched = config.get("unmatched", "keep")
    modes = unmatched.values() if isinstance(unmatched, dict) else [unmatched]
    out += [R.error(R.CONFIG_INVALID, field="unmatched", value=str(m)) for m in modes if m not in UNMATCHED]
    return out


def _mapped(table: Table, mappings: list[dict]) -> dict[str, Col]:
    """Result name -> column, in the table's own order. A mapping applies where ``from`` is present and would not
    take the name of a column the table already has."""
    target = {m["from"]: m["target"] for m in mappings}
    out: dict[str, Col] = {}
    for c in table.cols:
        name = target.get(c.name, c.name)
        if name in out or (name != c.name and table.has(name) and name not in target):
            R.refuse_if([R.error(R.RENAME_COLLISION, name=name, column=c.name)])
        out[name] = c
    return out


def partial_columns(tables: list[Table], mappings: list[dict]) -> dict[str, list[int]]:
    """Columns only some inputs have, with the slots that have them. Read off the schemas; no job runs."""
    slots = [_mapped(t, mappings) for t in tables]
    names = list(dict.fromkeys(n for s in slots for n in s))
    having = {n: [i for i, s in enumerate(slots) if n in s] for n in names}
    return {n: at for n, at in having.items() if len(at) < len(tables)}


def _inexact(types: list[T.DataType]) -> tuple[str, str] | None:
    """Two types of one column that no type holds exactly: Spark would make doubles of 64-bit integers or decimals."""
    binary = [t for t in types if isinstance(t, (T.FloatType, T.DoubleType))]
    exact = [t for t in types if isinstance(t, (T.LongType, T.DecimalType))]
    return (exact[0].simpleString(), binary[0].simpleString()) if binary and exact else None


def union_tables(
    tables: list[Table],
    mappings: list[dict] = (),
    unmatched: str | dict[str, str] = "keep",
    report: R.Report | None = None,
) -> Table:
    """All rows of all inputs in slot order. Columns come in the first input's order, then new ones as they appear.

    ``unmatched`` says what happens to a column some input lacks - ``keep`` (NULL where absent) or ``drop`` - for all
    such columns or per column. Two inputs whose shared column differs in kind are refused, and so are 64-bit
    integers or decimals beside doubles: Spark would coerce.
    """
    mappings = list(mappings)
    R.refuse_if(validate({"mappings": mappings, "unmatched": unmatched}))
    if len(tables) < 2:
        R.refuse_if([R.error(R.CONFIG_INVALID, field="inputs", value=str(len(tables)))])
    known = {c.name for t in tables for c in t.cols}
    R.refuse_if([R.error(R.UNKNOWN_COLUMN, column=m["from"]) for m in mappings if m["from"] not in known])

    slots = [_mapped(t, mappings) for t in tables]
    partial = partial_columns(tables, mappings)
    mode = unmatched.get if isinstance(unmatched, dict) else (lambda name, default: unmatched)
    names = [n for n in dict.fromkeys(n for s in slots for n in s) if n not in partial or mode(n, "keep") == "keep"]
    clashes = []
    for name in names:
        kinds = list(dict.fromkeys(s[name].kind for s in slots if name in s))
        if len(kinds) > 1:
            clashes.append(R.error(R.TYPE_MISMATCH, column=name, columnType=kinds[0], valueType=kinds[1]))
        elif inexact := _inexact([t.df.schema[s[name].name].dataType for t, s in zip(tables, slots) if name in s]):
            clashes.append(R.error(R.TYPE_MISMATCH, column=name, columnType=inexact[0], valueType=inexact[1]))
    R.refuse_if(clashes)
    if report is not None:
        if partial:
            report.add(R.info(R.UNION_PARTIAL_COLUMNS, columns=partial))
        if len({id(t.df) for t in tables}) < len(tables):
            report.add(R.warning(R.UNION_SAME_INPUT))

    cols, taken = [], set(names)
    for n in names:
        having = [s[n] for s in slots if n in s]
        raw = free_name(n + RAW_SUFFIX, taken) if any(c.raw for c in having) else None
        nanos = free_name(n + NANOS_SUFFIX, taken) if any(c.nanos for c in having) else None
        cols.append(Col(n, having[0].kind, raw, having[0].affix, nanos))

    ordered = all(t.order for t in tables)
    shapes = [_order_shape(t) for t in tables]
    shared = ordered and all(s == shapes[0] for s in shapes)
    order: list[OrderKey] = [OrderKey(f"{ORDER_PREFIX}u")] if ordered else []
    frames = []
    for i, (table, slot) in enumerate(zip(tables, slots)):
        exprs = []
        for c in cols:
            if c.name in slot:
                cell = col(slot[c.name].name)
                exprs.append(cell.alias(c.name))
                if slot[c.name].raw:
                    exprs.append(box_of(col(slot[c.name].raw), c.name, c.raw))
                if c.nanos:
                    exprs.append(nanos_of(F.when(cell.isNotNull(), slot[c.name].below), c.name, c.nanos))
        if ordered:
            exprs.append(F.lit(i).alias(f"{ORDER_PREFIX}u"))
            # Inputs ordered alike share their order columns; others get their own, NULL in every other slot.
            for k, key in enumerate(table.order):
                name = f"{ORDER_PREFIX}u{'' if shared else i}_{k}"
                exprs.append(col(key.name).alias(name))
                if not shared or i == 0:
                    order.append(OrderKey(name, key.descending))
        frames.append(table.df.select(*exprs))
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    keep = [x for c in cols for x in (col(c.name), *map(col, c.hidden))]
    if report is not None:
        for table in tables:
            report.close(table)
    return Table(df.select(*keep, *[col(k.name) for k in order]), tuple(cols), tuple(order))


def _order_shape(table: Table) -> list[tuple]:
    types = {f.name: f.dataType for f in table.df.schema.fields}
    return [(types[k.name].simpleString(), k.descending) for k in table.order]


def apply(inputs: list[Table], config: dict, report: R.Report | None = None) -> Table:
    return union_tables(inputs, config.get("mappings", []), config.get("unmatched", "keep"), report)
