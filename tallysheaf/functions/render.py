"""Writing cells in German conventions: ``1.234,56``, ``31.12.2025``, ``wahr``; a box writes its own text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..table import BOOLEAN, DATE, DATETIME, DURATION, NUMBER, TIME, Col, Table, col

_SECOND = 1_000_000_000
_NUMBER_FORMAT = "#,##0." + "#" * 20


def _pad2(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def number_text(value: Column) -> Column:
    return F.translate(F.call_function("format_number", value, F.lit(_NUMBER_FORMAT)), ",.", ".,")


def date_text(value: Column) -> Column:
    return F.date_format(value, "dd.MM.y")


def datetime_text(value: Column, nanos: Column | None = None) -> Column:
    """Seconds only where there are any, the fraction without trailing zeros."""
    fraction = F.date_format(value, "SSSSSS")
    if nanos is not None:
        fraction = F.concat(fraction, F.lpad(F.coalesce(nanos, F.lit(0)).cast("string"), 3, "0"))
    fraction = F.rtrim(fraction, F.lit("0"))
    clock = (
        F.when(fraction != "", F.concat(F.date_format(value, "HH:mm:ss"), F.lit(","), fraction))
        .when(F.second(value) > 0, F.date_format(value, "HH:mm:ss"))
        .otherwise(F.date_format(value, "HH:mm"))
    )
    return F.concat(date_text(value), F.lit(" "), clock)


def _clock_text(nanos: Column, pad_hours: bool) -> Column:
    size = F.abs(nanos)
    whole = ((size - size % _SECOND) / _SECOND).cast("bigint")
    hours, minutes, rest = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    base = F.concat(_pad2(hours) if pad_hours else hours.cast("string"), F.lit(":"), _pad2(minutes))
    base = F.when(rest > 0, F.concat(base, F.lit(":"), _pad2(rest))).otherwise(base)
    return F.when(nanos < 0, F.concat(F.lit("-"), base)).otherwise(base)


def cell_text(c: Col) -> Column:
    """The German text of one cell: NULL is empty, a box is its original text."""
    value = col(c.name)
    if c.kind == NUMBER:
        text = number_text(value)
    elif c.kind == BOOLEAN:
        text = F.when(value, "wahr").when(~value, "falsch")
    elif c.kind == DATE:
        text = date_text(value)
    elif c.kind == DATETIME:
        text = datetime_text(value, col(c.nanos) if c.nanos else None)
    elif c.kind == TIME:
        text = _clock_text(value, pad_hours=True)
    elif c.kind == DURATION:
        text = _clock_text(value, pad_hours=False)
    else:
        text = value.cast("string")
    return F.coalesce(text, col(c.raw), F.lit("")) if c.raw else F.coalesce(text, F.lit(""))


def render_de(table: Table) -> Table:
    """Every cell as its German text; column order, row order and row count unchanged."""
    rendered = [cell_text(c).alias(c.name) for c in table.cols]
    df = table.df.select(*rendered, *[col(k.name) for k in table.order])
    return table.with_df(df, cols=tuple(Col(c.name, "text") for c in table.cols))
