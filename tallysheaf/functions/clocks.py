"""Reading datetimes, times of day and durations.

One clock grammar serves every datetime pattern: one- or two-digit hour, optional seconds, up to nine fractional
digits after ``.`` or ``,``, an optional offset of at most 14:00, and 24:00 as the next day's midnight.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates

_FRACTION = r"(?:[.,][0-9]{1,9})?"
_ZERO_FRACTION = r"(?:[.,]0{1,9})?"


def _offset(colon: str) -> str:
    return (
        rf"(?:[Zz]|(?!-00(?:{colon}00)?\z)[+-](?:(?:0[0-9]|1[0-3])(?:{colon}[0-5][0-9])?|14(?:{colon}00)?))?"
    )


EXTENDED = (
    rf"(?:(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9]{_FRACTION})?|24:00(?::00{_ZERO_FRACTION})?)" + _offset(":?")
)
BASIC = (
    rf"(?:(?:[01][0-9]|2[0-3])[0-5][0-9](?:[0-5][0-9]{_FRACTION})?|2400(?:00{_ZERO_FRACTION})?)" + _offset("")
)
TIME_SHAPE = r"(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?"
DURATION_SHAPE = r"[0-9]+:[0-5][0-9](?::[0-5][0-9])?"

#: Hours past this do not fit nanoseconds in a long.
MAX_DURATION_HOURS = 2_562_046


@dataclass(frozen=True)
class DatetimePattern:
    """What stands before the clock, and what separates the two."""

    key: str
    date_key: str
    separator: str
    iso: bool = False

    @property
    def date_shape(self) -> str:
        return dates.MONTH_NAME_SHAPE if self.date_key == dates.MONTH_NAME else dates.BY_KEY[self.date_key].shape

    @property
    def shape(self) -> str:
        extended = rf"{self.date_shape}{self.separator}{EXTENDED}"
        return rf"(?:{extended}|[0-9]{{8}}[Tt]{BASIC})" if self.iso else extended


DATETIME_PATTERNS = (
    DatetimePattern("ISO 8601", "yyyy-MM-dd", "[Tt]", iso=True),
    DatetimePattern("yyyy-MM-dd HH:mm", "yyyy-MM-dd", " "),
    DatetimePattern("dd.MM.yyyy HH:mm", "dd.MM.yyyy", " "),
    DatetimePattern("dd.MM.yy HH:mm", "dd.MM.yy", " "),
    DatetimePattern("month name and clock", dates.MONTH_NAME, " "),
)
DATETIME_KEYS = tuple(p.key for p in DATETIME_PATTERNS)
BY_KEY = {p.key: p for p in DATETIME_PATTERNS}


def _date_text(text: Column, p: DatetimePattern) -> Column:
    """The date in front of the clock, a basic ISO date rewritten to the extended form."""
    if p.date_key == dates.MONTH_NAME:
        return F.regexp_extract(text, r"\A(.*) [^ ]*\z", 1)
    if p.iso:
        extended = F.substring(text, 1, 10)
        basic = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
        return F.when(F.substring(text, 9, 1).isin("T", "t"), basic).otherwise(extended)
    return F.substring(text, 1, dates.BY_KEY[p.date_key].length)


def _date_parts(text: Column, p: DatetimePattern) -> tuple[Column, Column, Column]:
    day_text = _date_text(text, p)
    if p.date_key == dates.MONTH_NAME:
        return dates.month_name_parts(day_text)
    return dates.BY_KEY[p.date_key].parts(day_text)


def reads_as_datetime(text: Column, key: str) -> Column:
    p = BY_KEY[key]
    return text.rlike(rf"(?iu)\A{p.shape}\z") & dates.is_real_date(*_date_parts(text, p))


def _int_or_zero(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def _clock_text(text: Column, p: DatetimePattern) -> Column:
    """The clock of a text already known to be valid, a basic ISO clock rewritten to the extended form."""
    if p.date_key == dates.MONTH_NAME:
        return F.substring_index(text, " ", -1)
    if not p.iso:
        return F.substring(text, F.lit(dates.BY_KEY[p.date_key].length + 2), F.length(text))
    basic = F.regexp_replace(F.substring(text, F.lit(10), F.length(text)), r"\A([0-9]{2})([0-9]{2})", "$1:$2")
    basic = F.regexp_replace(basic, r"\A(.{5})([0-9]{2})", "$1:$2")
    return F.when(F.substring(text, 9, 1).isin("T", "t"), basic).otherwise(
        F.substring(text, F.lit(12), F.length(text)))


def parse_datetime(text: Column, key: str) -> Column:
    """UTC microseconds as TIMESTAMP_NTZ, the offset applied and 24:00 rolled to the next day; NULL if unreadable. Digits
    below are those of :func:`nanos_below`."""
    p = BY_KEY[key]
    # Unreadable text becomes NULL first: what follows is then free of conditions, so its parts are computed once.
    fold = "(?iu)" if p.date_key == dates.MONTH_NAME else ""
    text = F.when(text.rlike(rf"{fold}\A{p.shape}\z"), text)
    clock = _clock_text(text, p)
    # The clock as Spark reads it: no offset, and a point before the fraction, of which it takes six digits.
    bare = F.rtrim(F.substring_index(F.substring_index(clock, "+", 1), "-", 1), F.lit("Zz"))
    late = clock.startswith("24")
    clean = F.translate(F.when(late, "00:00").otherwise(bare), ",", ".")
    if p.date_key == dates.MONTH_NAME:
        day = dates.date_from_shape(_date_text(text, p), p.date_key).cast("string")
    else:
        day = dates.iso_text(_date_text(text, p), p.date_key)
    whole = F.concat(day, F.lit("T"), clean).try_cast("timestamp_ntz")
    offset = F.replace(F.substring(clock, F.length(bare) + 1, F.lit(6)), F.lit(":"), F.lit(""))
    away = _int_or_zero(F.substring(offset, 2, 2)) * 60 + _int_or_zero(F.substring(offset, 4, 2))
    minutes = F.when(late, 1440).otherwise(0) - F.when(offset.startswith("-"), -away).otherwise(away)
    shifted = whole + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    return F.when(late | clock.contains("+") | clock.contains("-"), shifted).otherwise(whole)


#: A text that ends in seven to nine fraction digits, and an offset or none.
BELOW_MICRO = r"[.,][0-9]{6}([0-9]{1,3})(?:[Zz]|[+-][0-9:]+)?\z"


def nanos_below(text: Column) -> Column:
    """The nanoseconds, 0 to 999, that a readable datetime has below its microseconds."""
    return F.rpad(F.regexp_extract(text, BELOW_MICRO, 1), 3, "0").cast("int")


def reads_as_time(text: Column) -> Column:
    return text.rlike(rf"\A{TIME_SHAPE}\z")


def reads_as_duration(text: Column) -> Column:
    return text.rlike(rf"\A{DURATION_SHAPE}\z")


def _clock_nanos(text: Column) -> Column:
    parts = F.split(text, ":")
    hours = F.get(parts, F.lit(0)).try_cast("bigint")
    minutes = F.get(parts, F.lit(1)).try_cast("bigint")
    seconds = F.coalesce(F.get(parts, F.lit(2)).try_cast("bigint"), F.lit(0))
    return F.when(hours <= MAX_DURATION_HOURS, (hours * 3600 + minutes * 60 + seconds) * F.lit(1_000_000_000))


def parse_time(text: Column) -> Column:
    """Nanoseconds since midnight."""
    return F.when(reads_as_time(text), _clock_nanos(text))


def parse_duration(text: Column) -> Column:
    """Nanoseconds; hours are unbounded up to what a long holds."""
    return F.when(reads_as_duration(text), _clock_nanos(text))
