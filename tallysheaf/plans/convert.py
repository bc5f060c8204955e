"""Turn text columns into typed ones under a confirmed typing. What cannot be read keeps its text beside a NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import report as R
from ..functions import booleans, clocks, dates, numbers
from ..functions.text import is_missing, trimmed
from ..table import (
    BOOLEAN, DATE, DATETIME, DURATION, NANOS_SUFFIX, NUMBER, RAW_SUFFIX, TEXT, TIME, Col, Table, box_of, col,
    free_name, nanos_of,
)
from .detect import ColumnTyping, Typing, _not_finite


def reading(text: Column, c: ColumnTyping) -> Column:
    """The typed value of a trimmed text, NULL where it does not read: the same grammar detection counted with."""
    if c.type == NUMBER:
        return numbers.parse_number(text, c.format, c.affix, c.accounting)
    if c.type == DATE:
        return dates.parse_date(text, c.format)
    if c.type == DATETIME:
        return clocks.parse_datetime(text, c.format)
    if c.type == TIME:
        return clocks.parse_time(text)
    if c.type == DURATION:
        return clocks.parse_duration(text)
    if c.type == BOOLEAN:
        return booleans.parse_boolean(text, c.format)
    raise ValueError(f"no reading for a {c.type} column")


def convert(table: Table, typing: Typing) -> Table:
    """The table under its confirmed typing. Missing tokens become NULL, readable text its value, the rest a box.

    A column gets a companion only if detection counted unreadable values in it, or datetimes with digits below the
    microsecond, so a clean column costs nothing downstream. Companions are named so that no column's name is taken.
    """
    if not typing.confirmed:
        R.refuse_if([R.error(R.SOURCE_UNCONFIRMED, columns=typing.unresolved())])
    types = {f.name: f.dataType for f in table.df.schema.fields}
    order = [col(k.name) for k in table.order]
    taken = set(table.df.columns)
    texts = {c.name: free_name(f"__text{i}", taken) for i, c in enumerate(typing.columns) if not c.native}
    # Hours past a long read as a duration but have no value, so a duration column always has its companion.
    boxed = {c.name: free_name(c.name + RAW_SUFFIX, taken) for c in typing.columns if c.unparsed or c.type == DURATION}
    fine = {c.name: free_name(c.name + NANOS_SUFFIX, taken) for c in typing.columns if c.type == DATETIME and c.below_micro}

    # In stages, so that each cell is trimmed once and read once: trimmed text, value, box.
    trims = [F.coalesce(col(n), F.lit("")).alias(t) for n, t in texts.items()]
    df = table.df.select(*[col(c.name) for c in typing.columns], *order, *trims)
    df = df.select(*[col(c.name) for c in typing.columns], *order, *[
        trimmed(col(t)).alias(t) for t in texts.values()])
    # A missing token is NULL from here on; what follows needs no condition and can share its parts.
    df = df.select(*[col(c.name) for c in typing.columns], *order, *[
        F.when(~is_missing(col(texts[c.name]), c.tokens), col(texts[c.name])).alias(texts[c.name])
        for c in typing.columns if c.name in texts])
    values, boxes, cols = [], [], []
    for c in typing.columns:
        raw_text, raw_name = col(c.name), boxed.get(c.name)
        metadata = {"sheaf.kind": c.type, "sheaf.format": c.format or ""}
        if c.affix:
            metadata["sheaf.affix"] = c.affix
        if c.native:
            bad = _not_finite(c.name, types[c.name])
            values.append((F.when(~bad, raw_text) if raw_name else raw_text).alias(c.name, metadata=metadata))
            if raw_name:
                spelled = F.when(F.isnan(raw_text), "NaN").when(raw_text > 0, "Infinity").otherwise("-Infinity")
                values.append(box_of(F.when(bad, spelled), c.name, raw_name))
        else:
            text = col(texts[c.name])
            if c.type == TEXT:
                kept = F.when(text.isNotNull(), F.coalesce(raw_text, F.lit("")))
                values.append(kept.alias(c.name, metadata=metadata))
            else:
                values.append(reading(text, c).alias(c.name, metadata=metadata))
                if raw_name:
                    values.append(F.when(text.isNotNull(), raw_text).alias(raw_name))
                    boxes.append(c.name)
                if c.name in fine:
                    values.append(clocks.nanos_below(text).alias(fine[c.name]))
        held = table[c.name].nanos if c.native else fine.get(c.name)
        if c.native and held:
            values.append(col(held))
        cols.append(Col(c.name, c.type, raw_name, c.affix, held))
    df = df.select(*values, *order)
    if boxes or fine:
        kept = {boxed[n]: box_of(F.when(col(n).isNull(), col(boxed[n])), n, boxed[n]) for n in boxes}
        kept |= {f: nanos_of(F.when(col(n).isNotNull(), F.coalesce(col(f), F.lit(0))), n, f) for n, f in fine.items()}
        df = df.select(*[kept.get(n, col(n)) for n in df.columns])
    return table.with_df(df, cols=tuple(cols))
