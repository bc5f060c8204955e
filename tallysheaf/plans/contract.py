"""The input contract of a recipe - which columns of which source it reads, as what - and the check against it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from ..operators.columns import select_columns
from ..operators.join import output_columns
from ..table import TEXT, Table
from .detect import Typing, score_as
from .recipe import _contributing, _inputs

FITS, MISSING, DOUBTFUL = "fits", "missing", "doubtful"


@dataclass(frozen=True)
class Requirement:
    """One column a pipeline reads. ``type`` TEXT accepts anything; an optional column may be absent."""

    source: str
    column: str
    type: str = TEXT
    format: str | None = None
    optional: bool = False

    def loosened(self) -> Requirement:
        return replace(self, type=TEXT, format=None)


def derive_contract(recipe: dict, typings: Mapping[str, Typing]) -> list[Requirement]:
    """Only the columns that reach the result or steer a step, each with its confirmed type and locale."""
    lineage: dict[str, dict[str, set]] = {
        s: {c.name: {(s, c.name)} for c in t.columns} for s, t in typings.items()
    }
    used: set[tuple[str, str]] = set()
    for step in _contributing(recipe):
        kind, config = step["kind"], step.get("config") or {}
        inputs = [lineage[u] for u in _inputs(step)]
        one = inputs[0]

        def reads(*names, table=one):
            for n in names:
                used.update(table.get(n, ()))

        out = dict(one)
        if kind == "filter":
            reads(*[c["column"] for c in config.get("conditions", [])])
        elif kind == "sort":
            reads(*[k["column"] for k in config.get("keys", [])])
        elif kind == "columns" and config.get("columns"):
            out = {e.get("to") or e["from"]: one.get(e["from"], set()) for e in config["columns"]}
        elif kind == "computed":
            reads(*config["inputs"])
            out[config["name"]] = set().union(*(one.get(n, set()) for n in config["inputs"]))
        elif kind == "aggregate":
            reads(*config.get("by", []), *[a["column"] for a in config["aggs"] if a.get("column")])
            out = {n: one.get(n, set()) for n in config.get("by", [])}
        elif kind == "join":
            for k in config["keys"]:
                reads(k["left"])
                reads(k["right"], table=inputs[1])
            for name, right in _joined_names(one, inputs[1], config["keys"]):
                out[name] = inputs[1][right]
        elif kind == "union":
            target = {m["from"]: m["target"] for m in config.get("mappings", [])}
            slots = [{target.get(n, n): at for n, at in t.items()} for t in inputs]
            names = dict.fromkeys(n for s in slots for n in s)
            drop = config.get("unmatched", "keep") == "drop"
            out = {
                n: set().union(*(s.get(n, set()) for s in slots))
                for n in names if not drop or all(n in s for s in slots)
            }
        lineage[step["id"]] = out
    for origins in lineage[recipe["result"]].values():
        used |= origins
    return [
        Requirement(s, c.name, c.type, c.format)
        for s, t in typings.items() for c in t.columns if (s, c.name) in used
    ]


def _joined_names(left: Mapping, right: Mapping, keys: list[dict]):
    from ..table import Col

    shell = lambda names: Table(None, tuple(Col(n, TEXT) for n in names))
    return [(name, c.name) for c, name in output_columns(shell(left), shell(right), keys)]


@dataclass(frozen=True)
class Finding:
    requirement: Requirement
    verdict: str
    hit_rate: float | None = None
    available: tuple[str, ...] = ()


@dataclass(frozen=True)
class Preflight:
    findings: tuple[Finding, ...]

    @property
    def blocked(self) -> bool:
        return any(f.verdict == MISSING for f in self.findings)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (f.requirement.source, f.requirement.column, f.requirement.type, f.requirement.format, f.verdict,
             f.hit_rate, list(f.available))
            for f in self.findings
        ]
        return spark.createDataFrame(
            rows, "source string, column string, type string, format string, verdict string, hit_rate double, "
                  "available array<string>")


def preflight(contract: list[Requirement], typings: Mapping[str, Typing]) -> Preflight:
    """Each requirement fits, is missing (with the columns on offer), or is doubtful (with the share that reads).

    ``typings`` come from detection, one scan per source; scoring against the contract needs no further scan.
    """
    findings = []
    for need in contract:
        typing = typings.get(need.source)
        names = [c.name for c in typing.columns] if typing else []
        if need.column not in names:
            if not need.optional:
                findings.append(Finding(need, MISSING, None, tuple(names)))
            continue
        record = typing[need.column]
        if record.native:
            same = need.type in (TEXT, record.type)
            findings.append(Finding(need, FITS if same else DOUBTFUL, record.hit_rate if same else 0.0))
            continue
        scored = score_as(need.column, typing.histograms[need.column], need.type, need.format, record.tokens)
        findings.append(Finding(need, FITS if scored.unparsed == 0 else DOUBTFUL, scored.hit_rate))
    return Preflight(tuple(findings))


def map_columns(table: Table, mapping: Mapping[str, str]) -> Table:
    """Actual names to required ones; run the detection and the preflight again on what comes back."""
    return select_columns(table, [{"from": n, "to": mapping.get(n, n)} for n in table.names])
