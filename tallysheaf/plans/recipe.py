"""Run a recipe: a data-free description of sources, steps and one result, folded into one lazy Spark plan."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from .. import report as R
from ..operators import aggregate, columns, computed, filter, first, join, sort, union
from ..table import DATE, DATETIME, NUMBER, Table

FORMAT = "tallysheaf/recipe@1"
STEPS = {
    "filter": filter, "columns": columns, "sort": sort, "first": first,
    "union": union, "join": join, "computed": computed, "aggregate": aggregate,
}
ARITY = {"union": (2, None), "join": (2, 2)}
_FIELDS = {
    "recipe": {"format", "name", "description", "sources", "steps", "result"},
    "source": {"id", "name", "file", "columns"},
    "step": {"id", "name", "kind", "inputs", "config"},
    "filter": {"combine", "conditions"}, "columns": {"columns"}, "sort": {"keys"}, "first": {"count", "end"},
    "union": {"mappings", "unmatched"}, "join": {"keys", "type", "nullsMatch", "duplicateAudit"},
    "computed": {"name", "op", "inputs", "separator"}, "aggregate": {"by", "aggs"},
}


def _fault(reason: str, **values) -> R.Diagnostic:
    return R.error(f"recipe.{reason}", **values)


def _inputs(step: dict) -> list:
    given = step.get("inputs") or []
    return [given] if isinstance(given, str) else list(given)


def _unknown_fields(where: str, given: dict, at: str) -> list[R.Diagnostic]:
    return [_fault("unrecognised_field", at=at, field=f) for f in given if f not in _FIELDS[where]]


def validate(recipe) -> list[R.Diagnostic]:
    """Everything wrong with the recipe's structure. An orphan step is not a fault."""
    if not isinstance(recipe, dict):
        return [_fault("not_an_object")]
    out = _unknown_fields("recipe", recipe, "recipe")
    if recipe.get("format") != FORMAT:
        out.append(_fault("unknown_version", format=str(recipe.get("format"))))
    sources, steps = recipe.get("sources"), recipe.get("steps")
    for name, items in (("sources", sources), ("steps", steps)):
        if not isinstance(items, list) or not all(isinstance(i, dict) for i in items):
            out.append(_fault("missing_field", field=name))
    if any(d.code == "recipe.missing_field" for d in out):
        return out

    seen: set[str] = set()
    for item in [*sources, *steps]:
        id_ = item.get("id")
        if not isinstance(id_, str) or not id_:
            out.append(_fault("missing_field", field="id"))
        elif id_ in seen:
            out.append(_fault("duplicate_id", id=id_))
        seen.add(id_)
    for s in sources:
        out += _unknown_fields("source", s, str(s.get("id")))
    for s in steps:
        out += _unknown_fields("step", s, str(s.get("id")))
        kind = s.get("kind")
        if kind == "source":
            out.append(_fault("source_under_steps", id=s.get("id")))
            continue
        if kind not in STEPS:
            out.append(_fault("unknown_kind", id=s.get("id"), kind=str(kind)))
            continue
        low, high = ARITY.get(kind, (1, 1))
        inputs = _inputs(s)
        if len(inputs) < low or (high is not None and len(inputs) > high):
            out.append(_fault("wrong_arity", id=s["id"], kind=kind, inputs=len(inputs)))
        out += [_fault("dangling_input", id=s["id"], slot=i, input=str(u))
                for i, u in enumerate(inputs) if u not in seen]
        config = s.get("config")
        if isinstance(config, dict):
            out += _unknown_fields(kind, config, s["id"])
    result = recipe.get("result")
    if not result or result not in seen:
        out.append(_fault("missing_result", result=str(result)))
    elif any(s.get("id") == result for s in sources):
        out.append(_fault("result_is_source", result=result))
    cycle = _cycle(steps)
    if cycle:
        out.append(_fault("cycle", steps=cycle))
    return out


def _cycle(steps: list[dict]) -> list[str] | None:
    upstream = {s.get("id"): [u for u in _inputs(s)] for s in steps}
    done: set = set()
    for start in upstream:
        path: list = []
        stack = [(start, iter(upstream[start]))] if start not in done else []
        while stack:
            node, rest = stack[-1]
            if node not in path:
                path.append(node)
            nxt = next((u for u in rest if u in upstream and u not in done), None)
            if nxt is None:
                done.add(node)
                path.pop()
                stack.pop()
            elif nxt in path:
                return path[path.index(nxt):] + [nxt]
            else:
                stack.append((nxt, iter(upstream[nxt])))
    return None


_CANONICAL_NUMBER = re.compile(r"-?[0-9]+(\.[0-9]+)?")
_ISO = re.compile(r"-?[0-9]{4,6}-[0-9]{2}-[0-9]{2}([T ].*)?")


def normalise(conditions: list[dict], table: Table) -> list[dict]:
    """Comparison values in canonical form. A numeric string is taken as the number it spells; a display form - a
    group mark, a decimal comma, a date that is not ISO - is refused, naming what is wrong with it."""
    out, faults = [], []
    for c in conditions:
        value, name = c.get("value"), c.get("column")
        kind = table[name].kind if table.has(name) else None
        if kind == NUMBER and isinstance(value, str):
            if _CANONICAL_NUMBER.fullmatch(value):
                c = {**c, "value": float(value) if "." in value else int(value)}
            else:
                mark = next((m for m in (",", ".", " ", "'") if m in value), None)
                if mark and re.fullmatch(r"[-+0-9., ']+", value):
                    faults.append(_fault("display_form", column=name, value=value, character=mark))
        elif kind in (DATE, DATETIME) and isinstance(value, str) and not _ISO.fullmatch(value):
            faults.append(_fault("date_not_iso", column=name, value=value))
        out.append(c)
    R.refuse_if(faults)
    return out


@dataclass
class Run:
    """The outcome: a table per executed step, the result, and the report."""

    result_id: str
    tables: dict[str, Table | None] = field(default_factory=dict)
    report: R.Report = field(default_factory=R.Report)

    @property
    def table(self) -> Table | None:
        return self.tables.get(self.result_id)

    def status(self) -> dict:
        """Counts per severity; the steps' row counts are taken here, in one job."""
        return R.run_status(self.report.diagnostics())


def _contributing(recipe: dict) -> list[dict]:
    """The steps the result depends on, upstream first."""
    by_id = {s["id"]: s for s in recipe["steps"]}
    order: list[dict] = []
    seen: set[str] = set()
    stack = [(recipe["result"], False)]
    while stack:
        id_, ready = stack.pop()
        if id_ not in by_id:
            continue
        if ready:
            order.append(by_id[id_])
        elif id_ not in seen:
            seen.add(id_)
            stack.append((id_, True))
            stack += [(u, False) for u in reversed(_inputs(by_id[id_]))]
    return order


def run(recipe: dict, sources: Mapping[str, Table | None], counts: bool = True) -> Run:
    """Build the plan of the result step. ``sources`` maps ids to confirmed tables; None marks an unconfirmed one.

    Only steps feeding the result take part. A step that refuses leaves its dependants without a table while
    independent branches still run. No Spark job is started; with ``counts`` the report can say what each step did
    to the rows, and counts when it is read.
    """
    R.refuse_if(validate(recipe))
    steps = _contributing(recipe)
    source_ids = {s["id"] for s in recipe["sources"]}
    needed = [u for s in steps for u in _inputs(s) if u in source_ids]
    R.refuse_if([
        R.error(R.SOURCE_UNCONFIRMED, id=u) for u in dict.fromkeys(needed) if sources.get(u) is None
    ])

    out = Run(recipe["result"])
    out.tables.update({u: sources[u] for u in needed})
    failed = 0
    for s in steps:
        module, report = STEPS[s["kind"]], out.report.at(s["id"])
        upstream = _inputs(s)
        broken = [u for u in upstream if out.tables.get(u) is None]
        if broken:
            for u in broken:
                report.add(R.error(R.INPUT_FAILED, id=s["id"], slot=upstream.index(u), upstream=u))
            out.tables[s["id"]] = None
            failed += 1
            continue
        inputs = [out.tables[u] for u in upstream]
        config = s.get("config") or module.default_config()
        try:
            R.refuse_if(module.validate(config))
            if s["kind"] == "filter":
                config = {**config, "conditions": normalise(config["conditions"], inputs[0])}
            out.tables[s["id"]] = module.apply(inputs, config, report if counts else None)
        except R.Refused as refusal:
            for d in refusal.diagnostics:
                report.add(d)
            out.tables[s["id"]] = None
            failed += 1
        except Exception as thrown:  # whatever a step throws is that step's: other branches go on
            report.add(R.error(R.STEP_THREW, id=s["id"], reason=type(thrown).__name__, message=str(thrown).split("\n")[0][:300]))
            out.tables[s["id"]] = None
            failed += 1
    if counts:
        out.report.close(out.table)
    if failed:
        out.report.add(R.error(R.RUN_INCOMPLETE, steps=failed))
    return out


def probe(recipe: dict, sources: Mapping[str, Table | None], ceiling: int = 50):
    """The same run, read only, for looking: rows up to the ceiling, or a report that the result is larger.

    Returns (rows as a DataFrame or None, run).
    """
    outcome = run(recipe, sources, counts=False)
    if outcome.table is None:
        return None, outcome
    found = outcome.table.df.limit(ceiling + 1).count()
    if found > ceiling:
        outcome.report.add(R.warning(R.RESULT_TOO_LARGE, ceiling=ceiling))
        return None, outcome
    return outcome.table.ordered(), outcome
