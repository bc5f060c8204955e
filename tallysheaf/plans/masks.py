"""What every value of a text column could be read as, folded into one small histogram per column.

Each value becomes one 64-bit mask: a bit per reading that accepts it, a bit per separator it contains, and a few
flags. Grouping by (column, mask) turns a table of any size into a few hundred rows, from which every proposal,
re-score, conversion setting and ambiguity question can be answered without another scan.

Reading a value takes many tests, and most values differ from one another in nothing that a test sees: values are first
counted by a spelling that stands for all that are read alike (``spelling``), and masks are made of those few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import booleans, clocks, dates, numbers
from ..functions.text import DEFAULT_MISSING, WHITESPACE, is_missing, trimmed
from ..table import col

MARKS = (".", "/", "-", ":", ",", "%", "€", "$", " ")

_NAMES = [
    *[f"mark {m}" for m in MARKS],
    "de-DE", "en-US",               # reads as a number under every permission (accounting signs included)
    "accounting",                   # ... and does so only with accounting signs
    *[f"affix {a}" for a in numbers.AFFIXES],
    "overflow de-DE", "overflow en-US", "leading zero",
    *[f"date {k}" for k in dates.DATE_KEYS],
    *[f"datetime {k}" for k in clocks.DATETIME_KEYS],
    "time", "duration",
    *[f"boolean {k}" for k in booleans.PAIR_KEYS],
    "triple .", "triple /", "triple -",   # three two-digit parts no date pattern reads
    "day past twelve",              # a two-digit day-first triple whose day can be no month
    "sub-micro",                    # a datetime with digits below the microsecond
    "missing",
]
BIT = {name: 1 << i for i, name in enumerate(_NAMES)}

_TRIPLE = r"\A[0-9]{2}([./-])[0-9]{2}\1[0-9]{2}(?:[0-9]{2})?\z"
_OPENS_NUMBER = ("(", "+", "-", *numbers.AFFIXES)
_CLOSES_NUMBER = (")", "-", *numbers.AFFIXES)
_LONGEST_WORD = max(len(w) for yes, no, _ in booleans.PAIRS.values() for w in (yes, no))


def _flag(condition: Column, name: str) -> Column:
    return F.when(condition, F.lit(BIT[name])).otherwise(F.lit(0).cast("bigint"))


def _all(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def _guarded(condition: Column, bits: Column) -> Column:
    return F.when(condition, bits).otherwise(F.lit(0).cast("bigint"))


def _number_bits(v: Column) -> Column:
    return _all([
        F.col("numeric"),
        _flag((v.contains("(") | v.contains("-")) & v.rlike(numbers.ACCOUNTING_USED), "accounting"),
        *[_flag(v.contains(a), f"affix {a}") for a in numbers.AFFIXES],
        _guarded(F.length(v) >= len(numbers.MAX_SAFE_DIGITS), _all([
            _flag(numbers.integer_overflows(v, loc), f"overflow {loc}") for loc in numbers.LOCALES
        ])),
    ])


def _date_bits() -> Column:
    """Date bits of a bare value, or datetime bits where a clock followed: from the parts read off the date text."""
    d, clocked = F.col("d"), F.col("clock_ok") > 0
    mark, short = F.substring(d, 3, 1), F.length(d) == 8
    bare, timed = None, None
    for m in ("-", "/", "."):
        bits4 = [_flag(F.col(f"{o}_ok"), f"date {p.key}") for p, o in
                 ((p, p.order) for p in dates.NUMERIC_PATTERNS
                  if p.separator == m and not p.short_year and p.order != "ymd")]
        bits2 = [_flag(F.col(f"{p.order}_ok"), f"date {p.key}")
                 for p in dates.NUMERIC_PATTERNS if p.separator == m and p.short_year]
        read = F.col("dmy_ok") | F.col("mdy_ok")
        read = (read | F.col("ymd_ok")) if m == "-" else read
        bits2 += [_flag(~read, f"triple {m}")]
        both = F.when(short, _all(bits2)).otherwise(_all(bits4))
        bare = F.when(mark == m, both) if bare is None else bare.when(mark == m, both)
    bare = bare.otherwise(F.lit(0).cast("bigint")).bitwiseOR(
        _flag(short & F.col("dmy_ok") & (F.col("a") > 12), "day past twelve"))
    dotted = (mark == ".") & F.col("dmy_ok")
    timed = _all([
        _flag(dotted & ~short, "datetime dd.MM.yyyy HH:mm"), _flag(dotted & short, "datetime dd.MM.yy HH:mm"),
    ])
    iso = F.when(
        F.col("ymd_ok"),
        F.when(~clocked, F.lit(BIT["date yyyy-MM-dd"]))
        .when(F.col("clock_ok") == 1, F.lit(BIT["datetime yyyy-MM-dd HH:mm"]))
        .otherwise(F.lit(BIT["datetime ISO 8601"])),
    )
    named = F.when(
        F.col("name_ok"),
        F.when(clocked, F.lit(BIT["datetime month name and clock"])).otherwise(F.lit(BIT["date month name"])),
    )
    spaced = F.col("clock_ok") < 2
    return (
        F.when((F.col("shape") == 1) & spaced, F.when(clocked, timed).otherwise(bare))
        .when(F.col("shape") == 2, iso)
        .when((F.col("shape") == 3) & spaced, named)
    )


def _is_digit(character: Column) -> Column:
    return (character >= "0") & (character <= "9")


def _is_t(character: Column) -> Column:
    return character.isin("T", "t")


def with_masks(values: DataFrame, tokens: Sequence[str] = DEFAULT_MISSING) -> DataFrame:
    """``mask`` beside every trimmed value ``v``.

    Built in stages so that each compiles to a method of its own: separate clock from date, read the parts, check
    the calendar, fold the bits. Cheap tests guard the expensive ones.
    """
    keep = [c for c in values.columns if c != "v"]
    v = F.col("v")
    # Stage 1: where a clock may follow, cut the value at its last space or at the ISO T. Comparing texts is far
    # cheaper than matching them, so first and last characters decide what is worth a regular expression.
    opens_digit = (v >= "0") & (v < ":")
    ends_digit = _is_digit(F.right(v, F.lit(1)))
    iso_like = opens_digit & (_is_t(F.substring(v, 11, 1)) | _is_t(F.substring(v, 9, 1)))
    cut = values.select(
        *keep, v, opens_digit.alias("opens"), ends_digit.alias("ends"),
        F.when(iso_like, 2).when(v.contains(":") & v.contains(" "), 1).otherwise(0).alias("cut"),
    )
    at = F.when(F.col("cut") == 2, F.when(_is_t(F.substring(v, 9, 1)), 9).otherwise(11)).when(
        F.col("cut") == 1, F.length(v) - F.length(F.substring_index(v, " ", -1)))
    halves = cut.select(
        *keep, v, "opens", "ends", "cut",
        F.when(F.col("cut") > 0, F.substring(v, F.lit(1), at - 1)).otherwise(v).alias("d0"),
        F.when(F.col("cut") > 0, F.substring(v, at + 1, F.length(v))).alias("c"),
    )
    # Stage 2: is the clock a clock, and what shape has the date text? A basic ISO date pairs with a basic clock.
    d0 = F.col("d0")
    basic = (F.col("cut") == 2) & (F.length(d0) == 8)
    shaped = halves.select(
        *keep, v, "opens", "ends",
        F.when(basic, F.concat_ws("-", F.substring(d0, 1, 4), F.substring(d0, 5, 2), F.substring(d0, 7, 2)))
        .otherwise(d0).alias("d"),
        F.when(F.col("cut") == 0, 0)
        .when(basic, F.when(F.col("c").rlike(rf"\A{clocks.BASIC}\z"), 2).otherwise(-1))
        .when(F.col("c").rlike(rf"\A{clocks.EXTENDED}\z"), F.col("cut")).otherwise(-1).alias("clock_ok"),
    )
    d = F.col("d")
    shaped = shaped.select(
        *keep, v, "opens", "ends", "d", "clock_ok",
        F.when((F.col("clock_ok") < 0) | (F.length(d) > 40) | ~_is_digit(F.right(d, F.lit(1))), 0)
        .when(F.col("opens") & F.length(d).isin(8, 10) & d.rlike(_TRIPLE), 1)
        .when(F.col("opens") & (F.length(d) == 10) & d.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), 2)
        .when(d.contains(" ") & d.rlike(rf"(?iu)\A{dates.MONTH_NAME_SHAPE}\z"), 3).otherwise(0).alias("shape"),
    )
    # Stage 3: the parts, then the calendar.
    part = lambda start, length: F.substring(d, start, length).try_cast("int")
    shape = F.col("shape")
    parts = shaped.select(
        *keep, v, "opens", "ends", "d", "clock_ok", "shape",
        F.when(shape == 1, part(1, 2)).when(shape == 2, part(1, 4)).when(shape == 3, dates.month_name_parts(d)[0])
        .alias("a"),
        F.when(shape == 1, part(4, 2)).when(shape == 2, part(6, 2)).when(shape == 3, dates.month_name_parts(d)[1])
        .alias("b"),
        F.when(shape == 1, part(7, 4)).when(shape == 2, part(9, 2)).when(shape == 3, dates.month_name_parts(d)[2])
        .alias("c"),
    )
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    short = F.length(d) == 8
    years = parts.select(
        *keep, v, "opens", "ends", "d", "clock_ok", "shape", "a", "b", "c",
        F.when(shape == 1, F.when(short, dates.expand_two_digit_year(c)).otherwise(c)).alias("y"),
    )
    ymd = F.when(shape > 1, dates.is_real_date(a, b, c)).when(
        (shape == 1) & short, dates.is_real_date(dates.expand_two_digit_year(a), b, c))
    checked = years.select(
        *keep, v, "opens", "ends", "d", "clock_ok", "shape", "a",
        F.coalesce(F.when(shape == 1, dates.is_real_date(F.col("y"), b, a)), F.lit(False)).alias("dmy_ok"),
        F.coalesce(F.when(shape == 1, dates.is_real_date(F.col("y"), a, b)), F.lit(False)).alias("mdy_ok"),
        F.coalesce(ymd, F.lit(False)).alias("ymd_ok"),
    ).withColumn("name_ok", F.col("ymd_ok"))
    dated = checked.select(*keep, v, "opens", "ends", F.coalesce(_date_bits(), F.lit(0).cast("bigint")).alias("dated"))
    # Stage 4: numbers.
    opens, ends = F.col("opens"), F.col("ends")
    first, last = F.substring(v, 1, 1), F.right(v, F.lit(1))
    wrapped = (opens | first.isin(*_OPENS_NUMBER)) & (ends | last.isin(*_CLOSES_NUMBER))
    marked = v.contains(".") | v.contains(",")
    de, en = numbers.LOCALES
    german = F.when(opens & ends, v.rlike(numbers.pattern(de, None, False))).otherwise(
        v.rlike(numbers.any_wrapper_pattern(de)))
    english = F.when(~marked, F.col("german")).when(opens & ends, v.rlike(numbers.pattern(en, None, False))).otherwise(
        v.rlike(numbers.any_wrapper_pattern(en)))
    numeric = dated.select(*keep, v, "opens", "ends", "dated", (wrapped & german).alias("german"),
                           wrapped.alias("wrapped"))
    numeric = numeric.select(*keep, v, "opens", "dated", _flag(F.col("german"), de).bitwiseOR(
        _flag(F.col("wrapped") & english, en)).alias("numeric"))
    numbered = numeric.select(
        *keep, v, "opens", "dated", _guarded(F.col("numeric") > 0, _number_bits(v)).alias("numbered"))
    # Stage 5: everything else, folded.
    sub_micro = sum(BIT[f"datetime {k}"] for k in clocks.DATETIME_KEYS)
    zero = F.when(opens, (v >= "00") & (v < "0:")).when(
        first.isin(*_OPENS_NUMBER), v.rlike(numbers.LEADING_ZERO)).otherwise(F.lit(False))
    words = (F.length(v) <= _LONGEST_WORD) & (~opens | (F.length(v) == 1))
    mask = _all([
        *[_flag(v.contains(m), f"mark {m}") for m in MARKS],
        _guarded(words, _all([_flag(booleans.reads_as_boolean(v, k), f"boolean {k}") for k in booleans.PAIR_KEYS])),
        F.col("dated"), F.col("numbered"), _flag(zero, "leading zero"),
        _guarded(opens & v.contains(":") & clocks.reads_as_duration(v), _all([
            F.lit(BIT["duration"]), _flag(clocks.reads_as_time(v), "time")])),
        _guarded(F.col("dated").bitwiseAND(F.lit(sub_micro)) > 0,
                 _flag(v.rlike(clocks.BELOW_MICRO), "sub-micro")),
    ])
    return numbered.select(
        *keep, v, F.when(is_missing(v, tokens), F.lit(BIT["missing"])).otherwise(mask).alias("mask"))


_DIGITS = "23456789"
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = sorted({w for yes, no, fold in booleans.PAIRS.values() if fold for w in (yes, no)})
#: A character that no number has.
_NO_NUMBER = r"[^0-9.,+()%€$ -]"


def _folded(text: Column) -> Column:
    """Zeros and ones stay: leading zeros count, and 29 February is told elsewhere."""
    return F.translate(text, _DIGITS, "1" * len(_DIGITS))


def _marks_of(v: Column) -> Column:
    return F.concat(*[F.when(v.contains(m), m).otherwise("") for m in MARKS])


def _spelled_date(d: Column) -> Column:
    """A numeric date by what its calendar check sees: the year only where the day is 29 February or two digits are
    ambiguous. NULL for any other text."""
    third = F.substring(d, 3, 1)
    leap = F.substring(d, 1, 5).isin(*[f"{a}{m}{b}" for m in "./-" for a, b in (("29", "02"), ("02", "29"))])
    return F.when(
        (F.length(d) == 10) & (F.substring(d, 5, 1) == "-") & (F.substring(d, 8, 1) == "-"),
        F.when(F.substring(d, 6, 5) == "02-29", d).otherwise(F.concat(_folded(F.substring(d, 1, 4)), F.substring(d, 5, 6))),
    ).when(
        F.length(d).isin(8, 10) & third.isin(".", "/", "-") & (F.substring(d, 6, 1) == third),
        F.when((F.length(d) == 8) | leap, d).otherwise(F.concat(F.substring(d, 1, 6), _folded(F.substring(d, 7, 4)))),
    )


def spelling(v: Column, opens: Column, first: Column) -> Column:
    """A text with the same mask as the trimmed value ``v``, the same one for all values that are read alike.

    ``opens`` says whether it begins with a digit, ``first`` is its first character. Digits that no test tells apart
    become ones, clocks that read become one clock, and of a text that reads as nothing its marks are left. Calendar
    dates, words of booleans and numbers near a double's limit stay.
    """
    colon, space, size = v.contains(":"), v.contains(" "), F.length(v)
    zero = (v >= "00") & (v < "0:")
    plain = F.concat(F.when(~opens, "xxxxxxx").when(zero, "01xxxxxx").otherwise("1xxxxxx"), _marks_of(v))
    named = v.rlike(rf"(?iu)\A{dates.MONTH_NAME_SHAPE}(?: |\z)")
    # A date and a clock.
    ninth = _is_t(F.substring(v, 9, 1))
    iso_like = opens & (ninth | _is_t(F.substring(v, 11, 1)))
    at = F.when(iso_like, F.when(ninth, 9).otherwise(11)).otherwise(size - F.length(F.substring_index(v, " ", -1)))
    d, c = F.substring(v, F.lit(1), at - 1), F.substring(v, at + 1, size)
    basic = iso_like & ninth
    clocked = F.when(basic, c.rlike(rf"\A{clocks.BASIC}\z")).otherwise(c.rlike(rf"\A{clocks.EXTENDED}\z"))
    basic_date = F.when(F.substring(d, 5, 4) == "0229", d).otherwise(F.concat(_folded(F.substring(d, 1, 4)), F.substring(d, 5, 4)))
    day = F.when(basic, basic_date).otherwise(F.coalesce(_spelled_date(d), F.when(named, d)))
    clock = F.when(c.startswith("24"), c).otherwise(F.translate(c, "0" + _DIGITS, "1" * 9))
    moment = F.coalesce(F.when(clocked, F.concat(day, F.substring(v, at, F.lit(1)), clock)), plain)
    # Hours, minutes, seconds: two digits of hours decide whether they are a time of day.
    hours = F.substring_index(v, ":", 1)
    minutes = F.translate(F.substring(v, F.length(hours) + 1, size), "0" + _DIGITS, "1" * 9)
    duration = F.when(
        clocks.reads_as_duration(v), F.concat(F.when(F.length(hours) <= 2, hours).otherwise(_folded(hours)), minutes)).otherwise(plain)
    # A number, or a text with digits: sixteen digits from a nine on may be past what a double holds.
    number = F.when((size >= len(numbers.MAX_SAFE_DIGITS)) & v.rlike("9[0-9.,]{15,}"), v).otherwise(
        F.translate(v, _DIGITS + _LETTERS, "1" * len(_DIGITS) + "x" * len(_LETTERS)))
    wordy = ((size >= len(numbers.MAX_SAFE_DIGITS)) | space) & v.rlike(_NO_NUMBER)
    return (
        F.when(size == 1, v)
        .when(opens, F.when(colon & space | iso_like, moment).when(colon, duration).otherwise(F.coalesce(
            F.when(size.isin(8, 10), _spelled_date(v)), F.when(space & named, v), F.when(wordy, plain), number)))
        .when(first.isin(*_OPENS_NUMBER), F.when(wordy, F.when(v.rlike(numbers.LEADING_ZERO), v).otherwise(plain)).otherwise(number))
        .when((size <= _LONGEST_WORD) & F.lower(v).isin(*_WORDS), v)
        .when(space & named, F.when(colon, moment).otherwise(v))
        .otherwise(plain)
    )


#: Numbers of two to fifteen characters, numeric dates among them, and a readable clock behind a date of eight or ten.
_SHORT_NUMBER = r"^[0-9.,+()%€$ -]{2,15}$"
_NUMERIC_DATE = r"^(?:[0-9]{2}[./-][0-9]{2}[./-][0-9]{2}(?:[0-9]{2})?|[0-9]{4}-[0-9]{2}-[0-9]{2})$"
_MOMENT = (
    r"^(?:[0-9]{2}[./][0-9]{2}[./][0-9]{4} |[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ])(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"
    r"(?:[.,][0-9]{1,9})?(?:[Zz]|(?:\+0[0-9]|-0[1-9]|[+-]1[0-3]):[0-5][0-9])?$")


def _counted(df: DataFrame, names: Sequence[str], tokens: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Rows (at, v, n): the trimmed values of each column, counted by batch. Digits that no test tells apart are ones in
    short numbers and in the clocks behind dates; missing tokens stay as they are."""
    cells = [F.coalesce(col(n), F.lit("")) for n in names]
    if by:
        long = df.select(*by, F.posexplode(F.array(*cells)).alias("at", "v"))
        return long.select(*by, "at", trimmed(F.col("v")).alias("v"), F.lit(1).cast("bigint").alias("n"))
    rest, short, day, moment, edges, most, width = list(tokens), _SHORT_NUMBER, _NUMERIC_DATE, _MOMENT, WHITESPACE, 1 << 25, len(cells)

    def count(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        ones, some = np.arange(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)
        ones[ord("0") : ord("9") + 1] = ord("1")
        some[ord("2") : ord("9") + 1] = ord("1")
        known = pa.array(rest, pa.string())

        def folded(values, table):
            values = pa.concat_arrays([values])
            _, offsets, data = values.buffers()
            if data is None or not len(values):
                return values
            return pa.Array.from_buffers(pa.string(), len(values), [None, offsets, pa.py_buffer(table[np.frombuffer(data, np.uint8)])], offset=values.offset)

        def spelled(cells):
            v = pc.utf8_trim(cells, edges)
            number = pc.and_not(pc.match_substring_regex(v, short), pc.match_substring_regex(v, day))
            kept = pc.is_in(v, known)
            spelt = pc.if_else(pc.and_not(number, kept), folded(v, some), v)
            if pc.any(pc.match_substring(v, ":")).as_py():
                timed = pc.and_not(pc.match_substring_regex(v, moment), kept)
                moments = pc.binary_join_element_wise(pc.utf8_slice_codeunits(v, 0, 11), folded(pc.utf8_slice_codeunits(v, 11), ones), "")
                spelt = pc.if_else(timed, moments, spelt)
            return spelt

        held, size = [[] for _ in range(width)], 0

        def handed():
            for at, spelt in enumerate(held):
                if spelt:
                    counts = pc.value_counts(pa.chunked_array(spelt, pa.string()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(counts), at, np.int32)), counts.field(0), counts.field(1)], ["at", "v", "n"])
                    spelt.clear()

        for batch in batches:
            for at, column in enumerate(batch.columns):
                try:
                    spelt = spelled(column.cast(pa.string()))
                except pa.ArrowInvalid:  # bytes that are no text
                    spelt = column.cast(pa.string())
                held[at].append(spelt)
                size += spelt.nbytes
            # As many batches as fit some memory are counted together.
            if size > most:
                yield from handed()
                size = 0
        yield from handed()

    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).mapInArrow(count, "at int, v string, n bigint").withColumn(
        "v", trimmed(F.col("v")))


def mask_histogram(
    df: DataFrame, names: Sequence[str], tokens: dict[str, Sequence[str]] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Rows (at, mask, n) for the named text columns - one scan, two small shuffles. ``at`` is the column's index.

    The columns are stacked so that spellings and masks are compiled once however many columns there are. ``by`` keeps
    further columns in the grouping (a file, say).
    """
    long = _counted(df, names, sorted({w for n in names for w in (tokens or {}).get(n, DEFAULT_MISSING)}), by)
    lists: dict[tuple, list[int]] = {}
    for i, n in enumerate(names):
        lists.setdefault(tuple((tokens or {}).get(n, DEFAULT_MISSING)), []).append(i)
    if len(lists) == 1:
        missing = is_missing(F.col("v"), next(iter(lists)))
    else:
        missing = F.lit(False)
        for words, ats in lists.items():
            missing = missing | (F.col("at").isin(ats) & is_missing(F.col("v"), words))
    v = F.col("v")
    long = long.select(*by, "at", "n", v, missing.alias("missing"), ((v >= "0") & (v < ":")).alias("opens"), F.substring(v, 1, 1).alias("first"))
    spelt = long.select(*by, "at", "n", F.when(~F.col("missing"), spelling(v, F.col("opens"), F.col("first"))).alias("v"))
    counted = spelt.groupBy(*by, "at", "v").agg(F.sum("n").alias("n"))
    masked = with_masks(counted, ()).withColumn("mask", F.when(v.isNull(), F.lit(BIT["missing"])).otherwise(F.col("mask")))
    return masked.groupBy(*by, "at", "mask").agg(F.sum("n").alias("n"))
