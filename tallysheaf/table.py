"""The table a pipeline passes from step to step: a lazy DataFrame plus what a bare DataFrame cannot say.

Three things ride along and none of them costs anything until it is used:

* **kinds** - the seven column kinds (text, number, date, datetime, time, duration, boolean). Time and duration
  are nanosecond longs in Spark, so the Spark type alone does not identify them.
* **boxes** - a cell whose text could not be read under the confirmed type is NULL in ``c`` and keeps its text in
  a companion column. The companion exists only for columns that need one.
* **nanoseconds** - Spark's timestamps end at the microsecond. A datetime column with digits below it has a second
  companion, 0 to 999, and the two are one value wherever cells are compared, grouped, joined, ordered or written.
* **order** - a table has rows in an order and a DataFrame does not. Hidden columns ``__ord_<n>`` hold the sort
  keys in force, ending in the row's position in its source. A plan that never sorts prunes them away.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from .report import Trail

TEXT, NUMBER, DATE, DATETIME, TIME, DURATION, BOOLEAN = (
    "text", "number", "date", "datetime", "time", "duration", "boolean",
)
KINDS = (TEXT, NUMBER, DATE, DATETIME, TIME, DURATION, BOOLEAN)
TEMPORAL = frozenset({DATE, DATETIME, TIME, DURATION})

RAW_SUFFIX = "__raw"
NANOS_SUFFIX = "__ns"
#: Field metadata that names the column a companion belongs to. Names alone mean nothing: a source may use any.
BOX_OF, NANOS_OF = "sheaf.box_of", "sheaf.nanos_of"
ORDER_PREFIX = "__ord_"


def col(name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(name: str, taken: set[str]) -> str:
    """The name, or the first longer one that is free; taken from now on."""
    while name in taken:
        name += "_"
    taken.add(name)
    return name


def kind_of(data_type: T.DataType) -> str:
    """The column kind a Spark type stands for; everything without a kind of its own is text."""
    if isinstance(data_type, T.NumericType):
        return NUMBER
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, T.DateType):
        return DATE
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    return TEXT


@dataclass(frozen=True)
class Col:
    """One visible column: its name, its kind, its unit (``%``, ``€``, ``$`` or None) and its companions (or None): the
    text of its boxes, and the nanoseconds below its microseconds."""

    name: str
    kind: str
    raw: str | None = None
    affix: str | None = None
    nanos: str | None = None

    @property
    def boxed(self) -> Column:
        return col(self.raw).isNotNull() if self.raw else F.lit(False)

    @property
    def hidden(self) -> list[str]:
        return [h for h in (self.raw, self.nanos) if h]

    @property
    def below(self) -> Column:
        """The nanoseconds of a present cell, 0 in a column without any."""
        return F.coalesce(col(self.nanos), F.lit(0)) if self.nanos else F.lit(0)

    def renamed(self, name: str, taken: set[str]) -> tuple[list[Column], Col]:
        """The cells and companions under another name; companions take names that are free in ``taken``."""
        raw = free_name(name + RAW_SUFFIX, taken) if self.raw else None
        nanos = free_name(name + NANOS_SUFFIX, taken) if self.nanos else None
        cells = [col(self.name).alias(name)]
        cells += [box_of(col(self.raw), name, raw)] if raw else []
        cells += [nanos_of(col(self.nanos), name, nanos)] if nanos else []
        return cells, replace(self, name=name, raw=raw, nanos=nanos)


def box_of(cell: Column, name: str, companion: str) -> Column:
    """The column of box texts beside ``name``."""
    return cell.alias(companion, metadata={BOX_OF: name})


def nanos_of(cell: Column, name: str, companion: str) -> Column:
    """The column of nanoseconds beside ``name``."""
    return cell.cast("int").alias(companion, metadata={NANOS_OF: name})


@dataclass(frozen=True)
class OrderKey:
    """One hidden sort column and its direction."""

    name: str
    descending: bool = False

    def asc(self) -> Column:
        return col(self.name).desc_nulls_first() if self.descending else col(self.name).asc_nulls_last()

    def reverse(self) -> Column:
        return col(self.name).asc_nulls_last() if self.descending else col(self.name).desc_nulls_first()


@dataclass(frozen=True)
class Table:
    """A DataFrame with column kinds, box companions and an order in force."""

    df: DataFrame
    cols: tuple[Col, ...]
    order: tuple[OrderKey, ...] = ()
    #: The same rows for counting (see ``report.Trail``), where a run counts; row-wise steps take both along.
    trail: Trail | None = field(default=None, compare=False)

    # ---- making one -------------------------------------------------------------------------------------------

    @staticmethod
    def of(
        df: DataFrame, kinds: dict[str, str] | None = None, position: Sequence[Column] | None = None,
        boxes: dict[str, str] | None = None,
    ) -> Table:
        """Wrap a frame. Companions are the columns whose field metadata says so, and those that ``boxes`` names
        (column to companion); a column merely called like one is a column.

        ``position`` lists the expressions that order the rows; without it the table has no inherent order and
        the order-dependent steps refuse it.
        """
        names = df.columns
        metadata = {f.name: f.metadata or {} for f in df.schema.fields}
        types = {f.name: f.dataType for f in df.schema.fields}
        raws = {m[BOX_OF]: n for n, m in metadata.items() if m.get(BOX_OF) in types} | (boxes or {})
        nanos = {m[NANOS_OF]: n for n, m in metadata.items() if m.get(NANOS_OF) in types}
        hidden = {*raws.values(), *nanos.values()}
        cols = []
        for name in names:
            if name.startswith(ORDER_PREFIX) or name in hidden:
                continue
            kind = (kinds or {}).get(name) or metadata[name].get("sheaf.kind") or kind_of(types[name])
            cols.append(Col(name, kind, raws.get(name), metadata[name].get("sheaf.affix"), nanos.get(name)))
        keys = tuple(OrderKey(f"{ORDER_PREFIX}{i}") for i in range(len(position or ())))
        if keys:
            df = df.select("*", *[expr.alias(key.name) for expr, key in zip(position, keys)])
        return Table(df, tuple(cols), keys)

    # ---- reading it -------------------------------------------------------------------------------------------

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.cols]

    def has(self, name: str) -> bool:
        return any(c.name == name for c in self.cols)

    def __getitem__(self, name: str) -> Col:
        for c in self.cols:
            if c.name == name:
                return c
        raise KeyError(name)

    def schema(self) -> list[dict[str, str]]:
        return [{"name": c.name, "type": c.kind} for c in self.cols]

    def hidden_names(self) -> list[str]:
        return [h for c in self.cols for h in c.hidden] + [k.name for k in self.order]

    def frame(self, companions: bool = False) -> DataFrame:
        """The rows as an ordinary DataFrame, unordered; companions only when asked for."""
        keep = []
        for c in self.cols:
            keep.append(col(c.name))
            if companions:
                keep.extend(col(h) for h in c.hidden)
        return self.df.select(*keep)

    def ordered(self, companions: bool = False) -> DataFrame:
        """The rows in the order in force: one global sort."""
        df = self.df.orderBy(*[k.asc() for k in self.order]) if self.order else self.df
        return replace(self, df=df).frame(companions)

    def any_box(self) -> Column:
        """True where any visible cell of the row is boxed."""
        out = F.lit(False)
        for c in self.cols:
            if c.raw:
                out = out | c.boxed
        return out

    def with_df(self, df: DataFrame, **changes) -> Table:
        """Another frame under the same columns. What has been counted so far stays behind."""
        return replace(self, df=df, **{"trail": None, **changes})

    def selected(self, cells: Sequence[Column], **changes) -> Table:
        """The table of these cells of the same rows."""
        trail = self.trail and replace(self.trail, df=self.trail.df.select(*cells, *map(col, self.trail.flags)))
        return replace(self, df=self.df.select(*cells), trail=trail, **changes)

    def extended(self, cells: Sequence[Column], **changes) -> Table:
        """The table with these cells beside its own."""
        trail = self.trail and replace(self.trail, df=self.trail.df.select("*", *cells))
        return replace(self, df=self.df.select("*", *cells), trail=trail, **changes)


def named_order(table: Table, prefix: str) -> tuple[list[Column], list[OrderKey]]:
    """The table's order columns under fresh names, for steps that combine tables."""
    selected, keys = [], []
    for i, key in enumerate(table.order):
        name = f"{ORDER_PREFIX}{prefix}{i}"
        selected.append(col(key.name).alias(name))
        keys.append(OrderKey(name, key.descending))
    return selected, keys
