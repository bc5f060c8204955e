"""Comparison values: canonical machine form in, a typed literal out. A value that cannot be read is refused."""

from __future__ import annotations

import calendar
import math
import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..table import BOOLEAN, DATE, DATETIME, DURATION, NUMBER, TEXT, TIME

EXPECTED = {TEXT: "text", NUMBER: "number", BOOLEAN: "boolean", DATE: "text", DATETIME: "text", TIME: "text",
            DURATION: "text"}

# One grammar for all: named parts, which of them a kind is made of, and the largest value each may have.
_DAY = r"(?P<year>-?\d{4,6})-(?P<month>\d\d)-(?P<day>\d\d)"
_CLOCK = r"(?P<hour>\d\d):(?P<minute>\d\d)(?::(?P<second>\d\d)(?:\.(?P<nanos>\d{1,9}))?)?"
_SHAPES = {
    DATE: _DAY, TIME: _CLOCK, DATETIME: rf"{_DAY}[T ]{_CLOCK}(?:Z|(?P<side>[+-])(?P<ahead>\d\d):(?P<ahead_minute>\d\d))?",
    DURATION: r"(?P<side>-?)(?P<hours>\d+):(?P<minute>\d\d)(?::(?P<second>\d\d))?",
}
_MOST = {"hour": 23, "minute": 59, "second": 59, "ahead": 23, "ahead_minute": 59}
_NANOS = 10**9


def value_kind(value) -> str | None:
    """What a comparison value is: text, number, boolean, or nothing comparable."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number" if math.isfinite(value) else None
    return "text" if isinstance(value, str) else None


def _parts(kind: str, text: str) -> dict[str, int] | None:
    """The numbers in a text of this kind; None where it has another form or a part is out of range."""
    found = re.fullmatch(_SHAPES[kind], text, re.ASCII)
    if found is None:
        return None
    named = found.groupdict(default="")
    sign = -1 if named.pop("side", "") == "-" else 1
    named["nanos"] = named.get("nanos", "").ljust(9, "0")
    parts = {name: int(digits or 0) for name, digits in named.items()} | {"sign": sign}
    if any(parts.get(name, 0) > most for name, most in _MOST.items()):
        return None
    if "year" in parts:
        if not 1 <= parts["month"] <= 12 or not 1 <= parts["day"] <= calendar.monthrange(parts["year"], parts["month"])[1]:
            return None
    return parts


def _number(value: int | float) -> Column:
    """Exact past a long too: a decimal as far as one reaches, then the double nearest to it."""
    if isinstance(value, float) or -(2**63) <= value < 2**63:
        return F.lit(value)
    if abs(value) < 10**38:
        return F.lit(str(value)).cast("decimal(38,0)")
    return F.lit(float(value) if abs(value) < 10**308 else math.copysign(math.inf, value))


def typed_literal(kind: str, value) -> tuple[Column, int] | None:
    """(literal, nanoseconds beyond the literal) for a column of ``kind``, or None where the value is unreadable."""
    if kind not in _SHAPES:
        return (_number(value) if kind == NUMBER else F.lit(value)), 0
    p = _parts(kind, value)
    if p is None:
        return None
    if kind == DURATION:
        seconds = p["sign"] * (p["hours"] * 3600 + p["minute"] * 60 + p["second"])
        return _number(seconds * _NANOS), 0
    if kind == TIME:
        clock = timedelta(hours=p["hour"], minutes=p["minute"], seconds=p["second"])
        return F.lit(clock // timedelta(seconds=1) * _NANOS + p["nanos"]), 0
    day = F.make_date(F.lit(p["year"]), F.lit(p["month"]), F.lit(p["day"]))
    if kind == DATE:
        return day, 0
    ahead = p["sign"] * timedelta(hours=p["ahead"], minutes=p["ahead_minute"])
    clock = timedelta(hours=p["hour"], minutes=p["minute"], seconds=p["second"], microseconds=p["nanos"] // 1000) - ahead
    return day.cast("timestamp_ntz") + F.lit(clock), p["nanos"] % 1000
