"""From a histogram of value masks to a proposal per column: type, reading, counts, and what is still open.

Spark does the reading of every value (``masks``); what is left here is arithmetic over a few hundred counts, so a
user's correction - another type, another reading - is answered without touching the data again.

The arithmetic is one matrix per column: a row for each reading a value can have, a column for each mask that occurs,
true where a value with that mask reads so. Times the counts it gives every reading's hits; two rows side by side give
what decides between them. Which readings stand for election, and what strikes them out, is listed as data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import report as R
from ..functions import booleans, clocks, dates, numbers
from ..functions.text import DEFAULT_MISSING
from ..table import BOOLEAN, DATE, DATETIME, DURATION, KINDS, NUMBER, TEXT, TIME, Table, col
from .masks import BIT, mask_histogram

#: The share of non-missing values a reading must cover to be proposed over plain text.
PROPOSAL_THRESHOLD = 0.9

SETTLED, DECISIVE, UNRESOLVED = "settled", "decisive", "unresolved"

Mask = tuple[int, int]  # (mask, how many values carry it)

FORMATS = {
    NUMBER: tuple(numbers.LOCALES), DATE: dates.DATE_KEYS, DATETIME: clocks.DATETIME_KEYS,
    BOOLEAN: booleans.PAIR_KEYS,
}


@dataclass(frozen=True)
class ColumnTyping:
    """What one column is proposed (or chosen) to be, and the numbers behind it."""

    name: str
    type: str = TEXT
    format: str | None = None
    total: int = 0
    missing: int = 0
    parsed: int = 0
    verdict: str = SETTLED
    evidence: dict | None = None
    tokens: tuple[str, ...] = DEFAULT_MISSING
    native: bool = False
    affix: str | None = None
    accounting: bool = False
    mixed_affixes: tuple[str, ...] | None = None
    mixed_boolean_pairs: tuple[str, ...] | None = None
    note: str = ""
    chosen: bool = False
    below_micro: int = 0

    @property
    def unparsed(self) -> int:
        return self.total - self.missing - self.parsed

    @property
    def hit_rate(self) -> float:
        readable = self.total - self.missing
        return self.parsed / readable if readable else 1.0


# ---- readings as data ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Reading:
    """One way to read a value: by which bits a mask shows it, and which must be absent.

    Readings of one ``contest`` are alternatives to each other. A reading that is not ``offered`` stands for no
    election but can be chosen.
    """

    contest: str
    type: str
    format: str | None
    needs: int
    refuses: int = 0
    affix: str | None = None
    offered: bool = True

    @property
    def label(self) -> str:
        """What a question about this reading calls it."""
        return self.type if self.format is None else self.format


def _bits(*names: str) -> int:
    return sum(BIT[n] for n in names)


def _number_readings(marked: bool) -> list[Reading]:
    """A number stands under one unit, or none, and in one locale. Where no value shows a group or decimal mark, the
    locales read the same and one speaks for both; accounting signs don't count there either."""
    affixes = [None, *numbers.AFFIXES]
    out = []
    for rank, affix in enumerate(affixes):
        others = [f"affix {a}" for a in numbers.AFFIXES if a != affix]
        for at, locale in enumerate(numbers.LOCALES):
            needs = _bits(locale, *([f"affix {affix}"] if affix else []))
            refuses = _bits(*others, *([] if marked else ["accounting"]))
            out.append(Reading(f"{NUMBER} {rank}", NUMBER, locale, needs, refuses, affix, marked or at == 0))
    return out


def _plain_readings() -> list[Reading]:
    """Every other reading has a bit of its own. Times of day and durations are one contest between two types."""
    formats = [(DATE, dates.DATE_KEYS), (DATETIME, clocks.DATETIME_KEYS), (BOOLEAN, booleans.PAIR_KEYS)]
    out = [Reading(t, t, k, BIT[f"{t} {k}"]) for t, keys in formats[:2] for k in keys]
    out += [Reading("clock", t, None, BIT[t]) for t in (TIME, DURATION)]
    return out + [Reading(t, t, k, BIT[f"{t} {k}"]) for t, keys in formats[2:] for k in keys]


#: All readings, in the order in which equal hits are settled between types; by whether a column shows number marks.
READINGS = {marked: tuple(_number_readings(marked) + _plain_readings()) for marked in (False, True)}


class Matrix:
    """One column's readings × masks, and the counts."""

    def __init__(self, masks: Iterable[Mask]):
        masks = list(masks)
        present = [(m, n) for m, n in masks if not m & BIT["missing"]]
        self.total = sum(n for _, n in masks)
        self.size = sum(n for _, n in present)
        self.masks = np.array([m for m, _ in present], np.int64)
        self.counts = np.array([n for _, n in present], np.int64)
        self.marked = self.shows("mark .") or self.shows("mark ,")
        self.readings = READINGS[self.marked]
        needs = np.array([r.needs for r in self.readings], np.int64)[:, None]
        refuses = np.array([r.refuses for r in self.readings], np.int64)[:, None]
        self.reads = (self.masks & needs == needs) & (self.masks & refuses == 0)
        self.hits = self.reads @ self.counts
        self.at = {r: i for i, r in enumerate(self.readings)}

    def shows(self, *bits: str) -> bool:
        """Some one value carries all of these bits."""
        wanted = _bits(*bits)
        return bool(np.any(self.masks & wanted == wanted))

    def hit(self, reading: Reading) -> int:
        return int(self.hits[self.at[reading]])

    def where(self, **wanted) -> list[Reading]:
        return [r for r in self.readings if all(getattr(r, k) == v for k, v in wanted.items())]

    def ranked(self, readings: Iterable[Reading]) -> list[Reading]:
        """Most hits first; then in the order of contests, then by name."""
        contests = list(dict.fromkeys(r.contest for r in self.readings))
        return sorted(readings, key=lambda r: (-self.hit(r), contests.index(r.contest), r.label.casefold(), r.label))

    def apart(self, a: Reading, b: Reading) -> int:
        """How many values read as ``a`` and not as ``b``."""
        return int((self.reads[self.at[a]] & ~self.reads[self.at[b]]) @ self.counts)

    def spelled(self, type_: str, what: str) -> tuple[str, ...]:
        """The units, or pairs, under which some value of the column reads as this type, in declared order."""
        return tuple(dict.fromkeys(v for r in self.where(type=type_, offered=True) if (v := getattr(r, what)) and self.hit(r)))

    @property
    def unit(self) -> str | None:
        """The unit under which most values are numbers; none at all where another is no better."""
        return self.ranked(self.where(type=NUMBER, offered=True))[0].affix

    def too_large(self) -> bool:
        """Some value is a number under the column's unit, with more digits than a double holds."""
        return any(self.shows_within(r, f"overflow {r.format}") for r in self.where(type=NUMBER, affix=self.unit, offered=True))

    def shows_within(self, reading: Reading, bit: str) -> bool:
        return bool(np.any(self.reads[self.at[reading]] & (self.masks & BIT[bit] != 0)))


#: What strikes all readings of a type out: digits that a number would lose, or two spellings in one column.
STRIKES: tuple[tuple[str, Callable[[Matrix], bool]], ...] = (
    (NUMBER, lambda m: m.shows("leading zero")),
    (NUMBER, Matrix.too_large),
    (NUMBER, lambda m: len(m.spelled(NUMBER, "affix")) > 1),
    (BOOLEAN, lambda m: len(m.spelled(BOOLEAN, "format")) > 1),
)

_SHORT_YEARS = {p.key: p for p in dates.NUMERIC_PATTERNS if p.short_year}
#: Three two-digit parts may be no date at all. In this order: what a column shows, and what the column then is.
SHORT_YEAR_RULES: tuple[tuple[Callable[[Matrix, dates.DatePattern], bool], str], ...] = (
    (lambda m, p: m.shows(f"triple {p.separator}"), TEXT),
    (lambda m, p: not p.preferred, UNRESOLVED),
    (lambda m, p: not m.shows(f"date {p.key}", "day past twelve"), UNRESOLVED),
)


def _between(m: Matrix, best: Reading, rivals: list[Reading]) -> tuple[str, dict | None]:
    """Whether the values decide between a reading and the next best of its contest: they do only if more of them read
    as the first alone than as the second alone."""
    rival = next((r for r in rivals if r.contest == best.contest and r != best and m.hit(r)), None)
    if rival is None:
        return SETTLED, None
    evidence: dict = {"alternatives": [best.label, rival.label]}
    if best.format is None:
        evidence["over"] = "kind"
    alone, against = m.apart(best, rival), m.apart(rival, best)
    if alone <= against:
        return UNRESOLVED, evidence
    return DECISIVE, evidence | {"decidedBy": alone, "contested": against}


def _as(record: ColumnTyping, m: Matrix, best: Reading, **changes) -> ColumnTyping:
    """The record with a reading's type, format and counts."""
    number, timed = best.type == NUMBER, best.type == DATETIME
    found = {"type": best.type, "format": best.format, "parsed": m.hit(best), "affix": best.affix, "accounting": number and m.marked,
             "below_micro": _below_micro(m, best) if timed else 0}
    return replace(record, **(found | changes))


def _below_micro(m: Matrix, reading: Reading) -> int:
    return int((m.reads[m.at[reading]] & (m.masks & BIT["sub-micro"] != 0)) @ m.counts)


def detect_column(name: str, masks: Iterable[Mask], tokens: Sequence[str] = DEFAULT_MISSING) -> ColumnTyping:
    """The proposal for one text column: the reading most of its values have, if it covers nearly all, else text."""
    m = Matrix(masks)
    units, pairs = m.spelled(NUMBER, "affix"), m.spelled(BOOLEAN, "format")
    text = ColumnTyping(name, total=m.total, missing=m.total - m.size, parsed=m.size, tokens=tuple(tokens),
                        mixed_affixes=units if len(units) > 1 else None, mixed_boolean_pairs=pairs if len(pairs) > 1 else None)
    struck = {type_ for type_, applies in STRIKES if applies(m)}
    standing = m.ranked(r for r in m.readings if r.offered and r.type not in struck)
    best = standing[0]
    if not m.size or m.hit(best) / m.size < PROPOSAL_THRESHOLD:
        return text
    pattern = _SHORT_YEARS.get(best.format) if best.type == DATE else None
    doubt = next((then for shown, then in SHORT_YEAR_RULES if shown(m, pattern)), None) if pattern else None
    if doubt == TEXT:
        return text
    if doubt == UNRESOLVED:
        return _as(text, m, best, verdict=UNRESOLVED, evidence={"over": "kind", "alternatives": [DATE, TEXT]})
    verdict, evidence = _between(m, best, standing)
    return _as(text, m, best, verdict=verdict, evidence=evidence)


def _selectable(m: Matrix, type_: str) -> list[Reading]:
    """The readings that a chosen type starts from, best first: numbers under the column's unit, and of the boolean pairs
    only the one most values are spelled in."""
    if type_ == NUMBER:
        return m.ranked(m.where(type=NUMBER, affix=m.unit, offered=True))
    readings = m.ranked(m.where(type=type_))
    most = m.hit(readings[0])
    return [r for r in m.where(type=BOOLEAN) if m.hit(r) == most][:1] if type_ == BOOLEAN and most else readings


def score_as(
    name: str, masks: Iterable[Mask], type_: str, format: str | None = None, tokens: Sequence[str] = DEFAULT_MISSING
) -> ColumnTyping:
    """The column under a type the user chose. Without a reading the best one is taken - and where nothing in the
    column decides between two, none is: the column stays unresolved with an empty format."""
    if type_ not in KINDS:
        raise ValueError(f"unknown type: {type_}")
    m = Matrix(masks)
    record = ColumnTyping(name, type_, None, m.total, m.total - m.size, m.size, tokens=tuple(tokens), chosen=True)
    if type_ == TEXT:
        return record
    if format is not None:
        named = m.where(type=type_, format=format) if type_ != NUMBER else m.where(type=type_, format=format, affix=m.unit)
        if not named:
            raise ValueError(f"unknown format of a {type_}: {format}")
        return _as(record, m, named[0])
    readings = _selectable(m, type_)
    if type_ in (TIME, DURATION):
        return _as(record, m, readings[0])
    verdict, evidence = _between(m, readings[0], readings)
    record = _as(record, m, readings[0], verdict=verdict, evidence=evidence)
    return replace(record, format=None, below_micro=0) if verdict == UNRESOLVED else record


def best_format(masks: Iterable[Mask], type_: str) -> str | None:
    """The reading a freshly chosen type starts from; None where the column names none."""
    return score_as("", masks, type_).format


# ---- whole tables ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Typing:
    """The typing of a table: one record per column, and whether a person has confirmed it."""

    columns: tuple[ColumnTyping, ...]
    histograms: dict[str, tuple[Mask, ...]] = field(default_factory=dict, compare=False)
    confirmed: bool = False

    def __getitem__(self, name: str) -> ColumnTyping:
        return next(c for c in self.columns if c.name == name)

    def _with(self, record: ColumnTyping, confirmed: bool = False) -> Typing:
        columns = tuple(record if c.name == record.name else c for c in self.columns)
        return replace(self, columns=columns, confirmed=confirmed)

    def choose(self, name: str, type: str, format: str | None = None) -> Typing:
        """Another type or reading for one column; the hit rate follows at once, the confirmation drops."""
        before = self[name]
        if before.native:
            R.refuse_if([R.error("typing.native_type_fixed", column=name, type=before.type)])
        record = score_as(name, self.histograms[name], type, format, before.tokens)
        return self._with(replace(record, note=before.note))

    def annotate(self, name: str, note: str) -> Typing:
        """A note on a column. Changes nothing else, the confirmation included."""
        return self._with(replace(self[name], note=note), self.confirmed)

    def unresolved(self) -> list[str]:
        return [c.name for c in self.columns if c.verdict == UNRESOLVED]

    def confirm(self) -> Typing:
        """Refused, naming the columns, while any column is still undecided."""
        R.refuse_if([R.error("typing.unresolved_columns", columns=self.unresolved())] if self.unresolved() else [])
        return replace(self, confirmed=True)

    def carried_to(self, fresh: Typing) -> Typing:
        """After a re-read: choices and notes follow the column name; the confirmation does not."""
        old = {c.name: c for c in self.columns}
        out = []
        for c in fresh.columns:
            before = old.get(c.name)
            if before is not None and before.chosen and not c.native:
                c = score_as(c.name, fresh.histograms[c.name], before.type, before.format, c.tokens)
            out.append(replace(c, note=before.note) if before is not None else c)
        return replace(fresh, columns=tuple(out), confirmed=False)

    def tokens(self) -> dict[str, tuple[str, ...]]:
        return {c.name: c.tokens for c in self.columns}

    def diagnostics(self) -> list[R.Diagnostic]:
        out = []
        for c in self.columns:
            if c.verdict == UNRESOLVED:
                kind = (c.evidence or {}).get("over") == "kind"
                out.append(R.unresolved(
                    "typing.ambiguous_kind" if kind else "typing.ambiguous_locale",
                    column=c.name, alternatives=(c.evidence or {}).get("alternatives", [])))
            if c.mixed_affixes:
                out.append(R.warning("typing.mixed_affixes", column=c.name, affixes=c.mixed_affixes))
            if c.mixed_boolean_pairs:
                out.append(R.warning("typing.mixed_boolean_pairs", column=c.name, pairs=c.mixed_boolean_pairs))
            if c.unparsed:
                out.append(R.warning(
                    "typing.unparsed_values", column=c.name, unparsed=c.unparsed, readable=c.total - c.missing))
        if not self.confirmed:
            out.append(R.unresolved("typing.unconfirmed", columns=len(self.columns)))
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per column."""
        rows = [
            (c.name, c.type, c.format, c.total, c.missing, c.parsed, c.unparsed, c.verdict,
             (c.evidence or {}).get("alternatives"), (c.evidence or {}).get("decidedBy"),
             (c.evidence or {}).get("contested"), c.affix, c.note)
            for c in self.columns
        ]
        return spark.createDataFrame(
            rows,
            "column string, type string, format string, total bigint, missing bigint, parsed bigint, "
            "unparsed bigint, verdict string, alternatives array<string>, decided_by bigint, contested bigint, "
            "affix string, note string",
        )


def native_sweep(table: Table, names: Sequence[str]) -> DataFrame:
    """For columns a file typed itself: one row of ``missing`` and ``unreadable`` counts per column, in one scan."""
    types = {f.name: f.dataType for f in table.df.schema.fields}
    stats = []
    for i, n in enumerate(names):
        stats.append(R.count_if(col(n).isNull()).alias(f"m{i}"))
        stats.append(R.count_if(_not_finite(n, types[n])).alias(f"u{i}"))
    one = table.df.agg(F.count(F.lit(1)).alias("total"), *stats)
    entries = F.array(*[
        F.struct(F.lit(n).alias("column"), F.col("total"), F.col(f"m{i}").alias("missing"),
                 F.col(f"u{i}").alias("unreadable"))
        for i, n in enumerate(names)
    ])
    return one.select(F.explode(entries).alias("x")).select("x.*")


def _not_finite(name: str, data_type: T.DataType):
    if not isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.lit(False)
    cell = col(name)
    return F.isnan(cell) | (F.abs(cell) == float("inf"))


def detect_types(table: Table, tokens: dict[str, Sequence[str]] | None = None) -> Typing:
    """Propose a typing from every value. Text columns share one scan; typed columns are swept in another."""
    text = [c.name for c in table.cols if c.kind == TEXT]
    native = [c for c in table.cols if c.kind != TEXT]
    histograms: dict[str, list[Mask]] = {n: [] for n in text}
    if text:
        # A few hundred rows at most: the masks that occur, not the values.
        for row in mask_histogram(table.df, text, tokens).collect():
            histograms[text[row["at"]]].append((row["mask"], row["n"]))
    records = {n: detect_column(n, histograms[n], (tokens or {}).get(n, DEFAULT_MISSING)) for n in text}
    if native:
        for row in native_sweep(table, [c.name for c in native]).collect():
            c = table[row["column"]]
            records[c.name] = ColumnTyping(
                c.name, c.kind, None, row["total"], row["missing"],
                row["total"] - row["missing"] - row["unreadable"], native=True, affix=c.affix)
    return Typing(tuple(records[n] for n in table.names), {n: tuple(h) for n, h in histograms.items()})
