"""Reading calendar dates: fourteen numeric patterns of exact width, and dates with the month written out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DatePattern:
    """A numeric shape: which mark separates the parts, in which order they stand, how wide the year is."""

    key: str
    separator: str
    order: str
    short_year: bool = False
    preferred: bool = False

    @property
    def shape(self) -> str:
        year = r"[0-9]{2}" if self.short_year else r"[0-9]{4}"
        two = r"[0-9]{2}"
        parts = [year, two, two] if self.order == "ymd" else [two, two, year]
        return f"\\{self.separator}".join(parts)

    @property
    def length(self) -> int:
        return 8 if self.short_year else 10

    def parts(self, text: Column) -> tuple[Column, Column, Column]:
        """(year, month, day) of a text of this shape."""
        width = 2 if self.short_year else 4
        if self.order == "ymd":
            year, first, second = _int(text, 1, width), _int(text, width + 2, 2), _int(text, width + 5, 2)
            month, day = first, second
        else:
            first, second, year = _int(text, 1, 2), _int(text, 4, 2), _int(text, 7, width)
            day, month = (first, second) if self.order == "dmy" else (second, first)
        return (expand_two_digit_year(year) if self.short_year else year), month, day


def _int(text: Column, start: int, length: int) -> Column:
    return F.substring(text, start, length).try_cast("int")


def _mirrors(separator: str, letters: str) -> list[DatePattern]:
    d, m, s = "dd", "MM", separator
    return [
        DatePattern(f"{d}{s}{m}{s}yyyy", s, "dmy"),
        DatePattern(f"{m}{s}{d}{s}yyyy", s, "mdy"),
        DatePattern(f"{d}{s}{m}{s}yy", s, "dmy", short_year=True, preferred=True),
        DatePattern(f"{m}{s}{d}{s}yy", s, "mdy", short_year=True),
    ]


NUMERIC_PATTERNS: tuple[DatePattern, ...] = (
    *_mirrors(".", "dM"),
    *_mirrors("/", "dM"),
    *_mirrors("-", "dM"),
    DatePattern("yyyy-MM-dd", "-", "ymd"),
    DatePattern("yy-MM-dd", "-", "ymd", short_year=True),
)
MONTH_NAME = "month name"
DATE_KEYS = tuple(p.key for p in NUMERIC_PATTERNS) + (MONTH_NAME,)
BY_KEY = {p.key: p for p in NUMERIC_PATTERNS}

# The accepted spellings of each month (German and English, long and short, case folded, without the
# trailing point), January first.
MONTH_NAMES = (
    ("jan", "januar", "january"),
    ("feb", "februar", "february"),
    ("märz", "mär", "mar", "march"),
    ("apr", "april"),
    ("mai", "may"),
    ("juni", "jun", "june"),
    ("juli", "jul", "july"),
    ("aug", "august"),
    ("sept", "sep", "september"),
    ("okt", "oktober", "oct", "october"),
    ("nov", "november"),
    ("dez", "dezember", "dec", "december"),
)

_NAMES = "|".join(sorted((n for names in MONTH_NAMES for n in names), key=len, reverse=True))
_DAY = r"[0-9]{1,2}(?:st|nd|rd|th)?[.,]?"
#: Month first or second, the year last with four digits, one space between the parts.
MONTH_NAME_SHAPE = rf"(?:(?:{_NAMES})\.? {_DAY}|{_DAY} (?:{_NAMES})\.?) [0-9]{{4}}"


def expand_two_digit_year(year: Column) -> Column:
    """A fixed pivot, never a sliding one: 00-29 is 20yy, 30-99 is 19yy."""
    return F.when(year <= 29, year + 2000).otherwise(year + 1900)


def is_real_date(year: Column, month: Column, day: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    longest = (
        F.when(month.isin(1, 3, 5, 7, 8, 10, 12), 31)
        .when(month.isin(4, 6, 9, 11), 30)
        .when((month == 2) & leap, 29)
        .when(month == 2, 28)
        .otherwise(0)
    )
    return (day >= 1) & (day <= longest)


def _make_date(year: Column, month: Column, day: Column) -> Column:
    return F.when(is_real_date(year, month, day), F.make_date(year, month, day))


def month_number(name: Column) -> Column:
    """1-12 for an accepted spelling in any case, NULL otherwise."""
    folded = F.lower(F.rtrim(name, F.lit(".")))
    numbers = [F.lit(x) for number, names in enumerate(MONTH_NAMES, start=1) for n in names for x in (n, number)]
    return F.try_element_at(F.create_map(*numbers), folded)


def month_name_parts(text: Column) -> tuple[Column, Column, Column]:
    """(year, month, day) of a text of ``MONTH_NAME_SHAPE``."""
    day = F.regexp_extract(text, r"\A(?:\D+ )?([0-9]{1,2})", 1).try_cast("int")
    name = F.regexp_extract(text, r"(?iu)(?:\A| )([a-zä]+)\.?(?= )", 1)
    year = F.right(text, F.lit(4)).try_cast("int")
    return year, month_number(name), day


def reads_as_date(text: Column, key: str) -> Column:
    """Does the trimmed text read as a date under this pattern?"""
    if key == MONTH_NAME:
        return text.rlike(rf"(?iu)\A{MONTH_NAME_SHAPE}\z") & is_real_date(*month_name_parts(text))
    p = BY_KEY[key]
    return (F.length(text) == p.length) & text.rlike(rf"\A{p.shape}\z") & is_real_date(*p.parts(text))


def iso_text(text: Column, key: str) -> Column:
    """A text of a numeric pattern's shape as ``yyyy-MM-dd``."""
    p = BY_KEY[key]
    width = 2 if p.short_year else 4
    if p.order == "ymd":
        year, month, day = F.substring(text, 1, width), F.substring(text, width + 2, 2), F.substring(text, width + 5, 2)
    else:
        first, second, year = F.substring(text, 1, 2), F.substring(text, 4, 2), F.substring(text, 7, width)
        day, month = (first, second) if p.order == "dmy" else (second, first)
    # The pivot of expand_two_digit_year, as texts compare.
    century = [F.when(year < "30", "20").otherwise("19")] if p.short_year else []
    return F.concat(*century, year, F.lit("-"), month, F.lit("-"), day)


def date_from_shape(text: Column, key: str) -> Column:
    """The date of a text already known to have the pattern's shape; NULL for a day no calendar has."""
    if key == MONTH_NAME:
        return _make_date(*month_name_parts(text))
    return iso_text(text, key).try_cast("date")


def parse_date(text: Column, key: str) -> Column:
    """The date a trimmed text reads as, NULL where it does not read."""
    if key == MONTH_NAME:
        # Unreadable text becomes NULL first: what follows is then free of conditions, so its parts are computed once.
        return date_from_shape(F.when(text.rlike(rf"(?iu)\A{MONTH_NAME_SHAPE}\z"), text), key)
    p = BY_KEY[key]
    return date_from_shape(F.when((F.length(text) == p.length) & text.rlike(rf"\A{p.shape}\z"), text), key)
