"""What a run says beside its table: coded diagnostics, and the counts that fill them.

Counts are aggregates over the steps' own frames, taken together in one job when the diagnostics are read. They are
deliberately not accumulators riding on the result's job: those count a stage again whenever it runs again - for the
sampling pass of a global sort, or after an executor was lost - and a filter under one cannot reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INFO, WARNING, ERROR, UNRESOLVED = SEVERITIES = ("info", "warning", "error", "unresolved")

# The codes a step, a run or a reader reports under.
CONFIG_INVALID = "step.config_invalid"
RENAME_COLLISION = "step.rename_collision"
SORT_KEY_REPEATED = "step.sort_key_repeated"
UNKNOWN_COLUMN = "step.unknown_column"
TYPE_MISMATCH = "step.type_mismatch"
VALUE_UNREADABLE = "step.value_unreadable"
ROWS_REMOVED = "step.rows_removed"
BOXED_ROWS_DROPPED = "step.boxed_rows_dropped"
BOXED_ROWS_LAST = "step.boxed_rows_last"
BOXED_ROWS_KEPT = "step.boxed_rows_kept"
# Ours to name: joining, stacking, computing and grouping.
JOIN_UNMATCHED = "step.join_unmatched"
JOIN_GROWTH = "step.join_growth"
JOIN_NULL_KEYS = "step.join_null_keys"
JOIN_AUDIT = "step.join_duplicate_audit"
UNION_PARTIAL_COLUMNS = "step.union_partial_columns"
UNION_SAME_INPUT = "step.union_same_input"
COMPUTED_EMPTY = "step.computed_marked_empty"
AGGREGATE_ROWS = "step.aggregate_rows"
AGGREGATE_BOXES = "step.aggregate_boxes_skipped"
# Runs.
SOURCE_UNCONFIRMED = "run.source_unconfirmed"
KIND_NOT_EXECUTABLE = "run.kind_not_executable"
INPUT_MISSING = "run.input_missing"
INPUT_FAILED = "run.input_failed"
STEP_THREW = "run.step_threw"
RUN_INCOMPLETE = "run.run_incomplete"
RESULT_TOO_LARGE = "run.result_too_large"


@dataclass(frozen=True)
class Diagnostic:
    """One coded finding. ``values`` are numbers and names, never sentences."""

    severity: str
    code: str
    values: dict = field(default_factory=dict)
    step: str | None = None
    source: str | None = None

    def __post_init__(self):
        if self.severity not in SEVERITIES:
            raise ValueError(f"unknown severity: {self.severity}")
        if not self.code:
            raise ValueError("a diagnostic needs a code")

    def at(self, step: str | None) -> Diagnostic:
        return self if self.step is not None else Diagnostic(self.severity, self.code, self.values, step, self.source)


def error(code: str, **values) -> Diagnostic:
    return Diagnostic(ERROR, code, values)


def warning(code: str, **values) -> Diagnostic:
    return Diagnostic(WARNING, code, values)


def info(code: str, **values) -> Diagnostic:
    return Diagnostic(INFO, code, values)


def unresolved(code: str, **values) -> Diagnostic:
    return Diagnostic(UNRESOLVED, code, values)


class Refused(Exception):
    """A step or run that cannot produce a table. Every reason is carried, not only the first."""

    def __init__(self, diagnostics: Iterable[Diagnostic]):
        self.diagnostics = list(diagnostics)
        super().__init__("; ".join(f"{d.code} {d.values}" for d in self.diagnostics))


def refuse_if(diagnostics: list[Diagnostic]) -> None:
    if diagnostics:
        raise Refused(diagnostics)


@dataclass(frozen=True, eq=False)
class Trail:
    """The rows a step is to be counted over, none of them filtered out yet: ``alive`` is the column that tells which are
    still there, ``flags`` those that steps so far want counted. Between two exchanges all steps add to one trail, so
    that all their counts are one aggregate over one scan."""

    df: DataFrame
    alive: str | None = None
    flags: tuple[str, ...] = ()


class Report:
    """Collects a run's diagnostics: those known at once, and those written from counts when they are asked for."""

    def __init__(self, step: str | None = None, _shared: Report | None = None):
        self.step = step
        self._root = _shared or self
        if self._root is self:
            self._items: list = []
            self._pending: list[tuple[DataFrame, dict[str, Column]]] = []
            self._counted: list[dict] = []
            self._trails: list[Trail] = []
            self._tallied: dict[str, int] = {}
            self._flags = 0

    def at(self, step: str) -> Report:
        """The same report, speaking for one step."""
        return Report(step, self._root)

    def add(self, diagnostic: Diagnostic) -> None:
        self._root._items.append(diagnostic.at(self.step))

    def tally(self, table, **conditions: Column):
        """Register how many of a table's rows meet each condition. Returns the table, which takes its trail along, and the
        reader of the counts; nothing runs until it is called."""
        root = self._root
        trail = table.trail or Trail(table.df)
        alive = F.col(trail.alive) if trail.alive else F.lit(True)
        names = {metric: f"__flag{root._flags + i}" for i, metric in enumerate(conditions)}
        root._flags += len(names)
        flags = [(alive & F.coalesce(c, F.lit(False))).alias(names[m]) for m, c in conditions.items()]
        grown = Trail(trail.df.select("*", *flags), trail.alive, (*trail.flags, *names.values()))
        return replace(table, trail=grown), names, lambda: {m: root._tallies(grown)[n] for m, n in names.items()}

    def close(self, table) -> None:
        """The end of a trail: nothing more is counted on it. Trails that go on from the same steps are counted once."""
        root = self._root
        if table is not None and table.trail is not None and not any(t is table.trail for t in root._trails):
            root._trails.append(table.trail)

    def _tallies(self, grown: Trail) -> dict[str, int]:
        """The counts of all trails, in one job: each flag on the longest trail that has it."""
        if not set(grown.flags) <= set(self._tallied):
            open_ = sorted([*self._trails, grown], key=lambda t: -len(t.flags))
            self._tallied |= {r["flag"]: r["n"] for r in self._tally_plan(open_).collect()}
        return self._tallied

    def _tally_plan(self, trails: list[Trail]) -> DataFrame:
        """One branch per trail that has flags no longer one has."""
        seen, branches = set(self._tallied), []
        for t in trails:
            fresh = [f for f in t.flags if f not in seen]
            seen |= set(fresh)
            if fresh:
                counts = t.df.agg(*[count_if(F.col(f)).alias(f) for f in fresh])
                entries = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("n")) for f in fresh])
                branches.append(counts.select(F.explode(entries).alias("x")).select("x.flag", "x.n"))
        return reduce(DataFrame.union, branches)

    def count(self, df: DataFrame, **metrics: Column) -> Callable[[], dict]:
        """Register counts over a frame. Nothing runs until the returned reader, or any other, is called."""
        root = self._root
        at = len(root._pending)
        root._pending.append((df, metrics))
        return lambda: root._resolve()[at]

    def _resolve(self) -> list[dict]:
        """Take every registered count in one job, a branch per frame; Spark reuses what the branches share."""
        open_ = self._pending[len(self._counted):]
        if open_:
            rows = [
                df.agg(*[expr.alias(f"m{k}") for k, expr in enumerate(metrics.values())]).select(
                    F.lit(i).alias("at"), F.array(*[F.col(f"m{k}") for k in range(len(metrics))]).alias("counts"))
                for i, (df, metrics) in enumerate(open_)
            ]
            found = {r["at"]: r["counts"] for r in reduce(DataFrame.union, rows).collect()}
            self._counted += [dict(zip(metrics, found[i])) for i, (_, metrics) in enumerate(open_)]
        return self._counted

    def later(self, make: Callable[[], list[Diagnostic]]) -> None:
        """Register diagnostics that are written from counts."""
        step = self.step
        self._root._items.append(lambda: [d.at(step) for d in make()])

    def diagnostics(self) -> list[Diagnostic]:
        out: list[Diagnostic] = []
        for item in self._root._items:
            out.extend(item() if callable(item) else [item])
        return out


def run_status(diagnostics: Iterable[Diagnostic]) -> dict:
    """Counts per severity. Clean means nothing to warn about, nothing failed, nothing left open."""
    items = list(diagnostics)
    counts = {s: sum(d.severity == s for d in items) for s in SEVERITIES}
    return {"clean": counts[WARNING] + counts[ERROR] + counts[UNRESOLVED] == 0, "counts": counts, "diagnostics": items}


def diagnostics_frame(spark: SparkSession, diagnostics: Iterable[Diagnostic]) -> DataFrame:
    """The diagnostics of a run as rows, for storing beside the result."""
    rows = [
        (d.severity, d.code, d.step, d.source, {k: str(v) for k, v in d.values.items()}) for d in diagnostics
    ]
    schema = "severity string, code string, step string, source string, values map<string,string>"
    return spark.createDataFrame(rows, schema)


def count_if(condition: Column) -> Column:
    """Rows for which the condition holds; zero, never NULL, on no rows."""
    return F.count(F.when(condition, F.lit(1)))
