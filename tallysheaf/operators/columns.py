"""Keep, rename and reorder columns in one list."""

from __future__ import annotations

from .. import report as R
from ..table import Table, col


def default_config() -> dict:
    return {"columns": []}


def _pairs(columns) -> list[tuple]:
    return [
        (e.get("from"), e.get("from") if e.get("to") is None else e.get("to")) if isinstance(e, dict) else (None, None)
        for e in columns
    ]


def validate(config) -> list[R.Diagnostic]:
    if not isinstance(config, dict):
        return [R.error(R.CONFIG_INVALID, field="config")]
    if not isinstance(config.get("columns"), list):
        return [R.error(R.CONFIG_INVALID, field="columns")]
    out, taken = [], set()
    for at, (source, target) in enumerate(_pairs(config["columns"])):
        if not isinstance(source, str) or source == "":
            out.append(R.error(R.CONFIG_INVALID, field="from", at=at))
        elif not isinstance(target, str) or target == "":
            out.append(R.error(R.CONFIG_INVALID, field="to", at=at, column=source))
        elif target in taken:
            out.append(R.error(R.RENAME_COLLISION, name=target, at=at))
        else:
            taken.add(target)
    return out


def select_columns(table: Table, columns: list[dict], report: R.Report | None = None) -> Table:
    """``[{"from": name, "to": new name}]``: list order is column order, an empty list changes nothing."""
    R.refuse_if(validate({"columns": columns}))
    pairs = _pairs(columns)
    if not pairs:
        return table
    R.refuse_if([R.error(R.UNKNOWN_COLUMN, column=source) for source, _ in pairs if not table.has(source)])
    exprs, cols, taken = [], [], {target for _, target in pairs}
    for source, target in pairs:
        cells, c = table[source].renamed(target, taken)
        exprs += cells
        cols.append(c)
    return table.selected([*exprs, *[col(k.name) for k in table.order]], cols=tuple(cols))


def apply(inputs: list[Table], config: dict, report: R.Report | None = None) -> Table:
    return select_columns(inputs[0], config.get("columns", []), report)
