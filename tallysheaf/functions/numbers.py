"""Reading numbers written the German or the English way, with a unit and with accounting signs.

A value is ``wrapper(core)``. The core is digits with strictly grouped thousands and at most one decimal mark; the
wrapper is at most one sign mark (``-``, ``+``, and for accounting columns ``(...)`` or a trailing ``-``) and at most
one unit, nested in either order with one optional space beside the unit. Each combination is one anchored regular
expression, so a reading is a predicate inside generated code and a value is a ``translate`` and a cast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two number readings (group mark, decimal mark) and the units a number may carry.
LOCALES = {"de-DE": (".", ","), "en-US": (",", ".")}
AFFIXES = ("%", "€", "$")

#: The largest integer part a double still tells apart from its neighbours.
MAX_SAFE_DIGITS = str(2**53 - 1)


def _core(locale: str) -> str:
    group, decimal = (f"\\{mark}" for mark in LOCALES[locale])
    return rf"[0-9]{{1,3}}+(?:(?:{group}[0-9]{{3}})++|[0-9]*+)(?:{decimal}[0-9]++)?+"


def pattern(locale: str, affix: str | None, accounting: bool) -> str:
    """The regular expression of one reading. ``affix`` may be a character class to accept any unit."""
    n = _core(locale)
    if affix is None:
        forms = [rf"[+-]?{n}"]
        if accounting:
            forms += [rf"\({n}\)", rf"{n}-"]
    else:
        a = affix if affix.startswith("[") else f"\\{affix}" if affix == "$" else affix
        forms = [rf"[+-]?{a} ?{n}", rf"{a} ?[+-]{n}", rf"[+-]?{n} ?{a}"]
        if accounting:
            forms += [
                rf"\({a} ?{n}\)", rf"\({n} ?{a}\)", rf"{a} ?\({n}\)", rf"\({n}\) ?{a}",
                rf"{a} ?{n}-", rf"{n} ?{a}-", rf"{n}- ?{a}",
            ]
    return rf"\A(?:{'|'.join(forms)})\z"


ANY_AFFIX = "[%€$]"


def any_wrapper_pattern(locale: str) -> str:
    """Every wrapper at once, units and accounting signs included."""
    bare, units = pattern(locale, None, True), pattern(locale, ANY_AFFIX, True)
    return rf"\A(?:{bare[5:-3]}|{units[5:-3]})\z"


#: Within a value some reading accepts: does it use an accounting sign?
ACCOUNTING_USED = r"[(]|[0-9].*-"

#: A leading zero is information (an article number, a postcode), seen through sign and unit.
LEADING_ZERO = (
    r"\A(?:0[0-9]"
    r"|[+-](?:[%€$] ?)?0[0-9](?!.*-(?: ?[%€$])?\z)"
    r"|[%€$] ?(?:0[0-9](?!.*--\z)|[+-]0[0-9](?!.*-\z))"
    r"|\((?:[%€$] ?)?0[0-9].*(?<!-)\)(?: ?[%€$])?\z"
    r"|[%€$] ?\(0[0-9].*(?<!-)\)\z)"
)


def plain_digits(text: Column, locale: str) -> Column:
    """A readable value as ``1234.5``: marks, signs and units gone, the decimal mark a point. No sign."""
    group, decimal = LOCALES[locale]
    return F.translate(text, decimal + group + "+-()%€$ ", ".")


def integer_overflows(text: Column, locale: str) -> Column:
    """For a readable value: is its integer part past what a double holds exactly?"""
    integer = F.ltrim(F.substring_index(plain_digits(text, locale), ".", 1), F.lit("0"))
    width = len(MAX_SAFE_DIGITS)
    return (F.length(integer) > width) | ((F.length(integer) == width) & (integer > MAX_SAFE_DIGITS))


def parse_number(text: Column, locale: str, affix: str | None = None, accounting: bool = False) -> Column:
    """The double a trimmed text reads as, NULL where it does not read."""
    # Unreadable text becomes NULL first: what follows is read once, its sign in front.
    text = F.when(text.rlike(pattern(locale, affix, accounting)), text)
    sign = F.when(text.contains("-") | text.contains("("), "-").otherwise("")
    return F.concat(sign, plain_digits(text, locale)).try_cast("double")
