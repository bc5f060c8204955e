"""Add one column computed from others: arithmetic, ratio, concatenation, difference in days. No formula language."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from .. import report as R
from ..functions.render import cell_text
from ..table import DATE, NUMBER, RAW_SUFFIX, TEXT, Col, Table, box_of, col, free_name

ARITHMETIC = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": F.try_divide,
    "ratio": F.try_divide,
}
OPERATIONS = (*ARITHMETIC, "concat", "date_diff_days")


def default_config() -> dict:
    return {"name": "", "op": "add", "inputs": []}


def validate(config) -> list[R.Diagnostic]:
    if not isinstance(config, dict):
        return [R.error(R.CONFIG_INVALID, field="config")]
    out = []
    if not isinstance(config.get("name"), str) or config["name"] == "":
        out.append(R.error(R.CONFIG_INVALID, field="name"))
    op, inputs = config.get("op"), config.get("inputs")
    if op not in OPERATIONS:
        out.append(R.error(R.CONFIG_INVALID, field="op", value=str(op)))
    enough = isinstance(inputs, list) and all(isinstance(n, str) and n for n in inputs) and (
        len(inputs) >= 2 if op == "concat" else len(inputs) == 2)
    if not enough:
        out.append(R.error(R.CONFIG_INVALID, field="inputs"))
    if not isinstance(config.get("separator", ""), str):
        out.append(R.error(R.CONFIG_INVALID, field="separator"))
    return out


def add_computed(
    table: Table, name: str, op: str, inputs: list[str], separator: str = "", report: R.Report | None = None
) -> Table:
    """``name`` = ``op`` over ``inputs``.

    A zero divisor or a boxed input gives a *marked empty* cell: NULL with an empty text in the companion - neither
    a zero nor an ordinary missing value. A missing input gives a missing result; ``concat`` skips missing parts.
    """
    R.refuse_if(validate({"name": name, "op": op, "inputs": inputs, "separator": separator}))
    faults = [R.error(R.UNKNOWN_COLUMN, column=n) for n in inputs if not table.has(n)]
    wanted = NUMBER if op in ARITHMETIC else DATE if op == "date_diff_days" else None
    faults += [
        R.error(R.TYPE_MISMATCH, column=n, columnType=table[n].kind, valueType=wanted)
        for n in inputs if wanted and table.has(n) and table[n].kind != wanted
    ]
    if table.has(name):
        faults.append(R.error(R.RENAME_COLLISION, name=name))
    R.refuse_if(faults)

    used = [table[n] for n in inputs]
    if op in ARITHMETIC:
        a, b = (col(n).cast("double") for n in inputs)
        value, kind = ARITHMETIC[op](a, b), NUMBER
    elif op == "date_diff_days":
        # First minus second: days from the second date to the first.
        value, kind = F.datediff(col(inputs[0]), col(inputs[1])).cast("bigint"), NUMBER
    else:
        parts = [col(c.name) if c.kind == TEXT else F.nullif(cell_text(c), F.lit("")) for c in used]
        value, kind = F.concat_ws(separator, *parts), TEXT

    marks = [c.boxed for c in used if c.raw]
    if op in ("divide", "ratio"):
        marks.append((col(inputs[1]) == 0) & col(inputs[0]).isNotNull())
    raw = None
    added = [value.alias(name)]
    if marks:
        marked = F.coalesce(reduce(or_, marks), F.lit(False))
        raw = free_name(name + RAW_SUFFIX, {name, *table.df.columns})
        added = [F.when(~marked, value).alias(name), box_of(F.when(marked, F.lit("")), name, raw)]
    out = table.extended(added, cols=(*table.cols, Col(name, kind, raw)))
    if raw and report is not None:
        out, _, seen = report.tally(out, marked=col(raw).isNotNull())
        report.later(lambda: [R.warning(R.COMPUTED_EMPTY, rows=seen()["marked"])] if seen()["marked"] else [])
    return out


def apply(inputs: list[Table], config: dict, report: R.Report | None = None) -> Table:
    return add_computed(
        inputs[0], config["name"], config["op"], config["inputs"], config.get("separator", ""), report)
