import datetime as dt

import pytest
from support import rows

from tallysheaf import report as R
from tallysheaf.functions.render import render_de
from tallysheaf.plans.convert import convert
from tallysheaf.plans.detect import detect_types

# values -> (type, format, verdict)
CASES = {
    "german": (["1.234,56"] * 19 + ["abc"], ("number", "de-DE", "settled")),
    "percent": (["12 %"] * 19 + ["9"], ("number", "de-DE", "settled")),
    "accounting": (["(1.234,56)", "1.000,00-", "5"], ("number", "de-DE", "decisive")),
    "footnotes": (["(1)", "(2)", "(3)"], ("text", None, "settled")),
    "part numbers": (["4711-", "12"], ("text", None, "settled")),
    "leading zero": (["0123", "12"], ("text", None, "settled")),
    "hidden zero": (["(0123)", "12"], ("text", None, "settled")),
    "too wide": (["9007199254740993", "1"], ("text", None, "settled")),
    "two units": (["12 €", "12 $"], ("text", None, "settled")),
    "plain integers": (["1", "2", "42"], ("number", "de-DE", "settled")),
    "thousands or decimals": (["1.234", "5.678"], ("number", "de-DE", "unresolved")),
    "dollars": (["-$1,234.56", "$5.00", "$ -3.10"], ("number", "en-US", "settled")),
    "day or month": (["03.04.2025", "05.06.2025"], ("date", "dd.MM.yyyy", "unresolved")),
    "late day": (["31.12.2025", "05.06.2025"], ("date", "dd.MM.yyyy", "decisive")),
    "american": (["12/31/2025", "05/06/2025"], ("date", "MM/dd/yyyy", "decisive")),
    "short year": (["31.12.25", "01.03.26"], ("date", "dd.MM.yy", "decisive")),
    "version numbers": (["01.02.03", "01.32.03", "04.05.06"], ("text", None, "settled")),
    "short open": (["03.04.25", "05.06.25"], ("date", "dd.MM.yy", "unresolved")),
    "short month first": (["12.31.25", "03.04.25"], ("date", "MM.dd.yy", "unresolved")),
    "truncated iso": (["25-12-31", "25-01-15", "25-06-30"], ("date", "dd-MM-yy", "unresolved")),
    "month names": (["2. Aug. 2026", "31. Juli 2026", "Aug 2nd, 2026", "2 MÄR 2026"], ("date", "month name", "settled")),
    "month and clock": (["2. Aug. 2026 04:44:34", "1. Mär. 2026 9:05"], ("datetime", "month name and clock", "settled")),
    "iso": (["2025-12-31T14:30:00+02:00", "20251231T143000.461Z", "2025-12-31t24:00"], ("datetime", "ISO 8601", "settled")),
    "database": (["2026-02-13 15:57:35.461+02:00", "2026-02-13 15:57"], ("datetime", "yyyy-MM-dd HH:mm", "settled")),
    "german clock": (["31.12.2025 9:05", "01.01.2025 24:00"], ("datetime", "dd.MM.yyyy HH:mm", "settled")),
    "bad offset": (["2025-12-31T14:30-00:00", "2025-12-31T14:30+14:30"], ("text", None, "settled")),
    "clock": (["9:05", "23:59"], ("duration", None, "unresolved")),
    "hours": (["9:05", "25:00"], ("duration", None, "decisive")),
    "yes and no": (["ja", "nein", "JA"], ("boolean", "ja/nein", "settled")),
    "mixed pairs": (["ja", "false"], ("text", None, "settled")),
    "no such day": (["29.02.2023", "29.02.2024"], ("text", None, "settled")),
    "exponent": (["1e5", "2"], ("text", None, "settled")),
    "all missing": (["", "-", "n/a", "k. A.", " – "], ("text", None, "settled")),
    "prose": (["12 Monkeys", "x"], ("text", None, "settled")),
}


@pytest.fixture(scope="module")
def typed(spark):
    from tallysheaf.table import Table

    height = max(len(v) for v, _ in CASES.values())
    columns = [v + [""] * (height - len(v)) for v, _ in CASES.values()]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(zip(*columns))], ["pos", *CASES])
    from pyspark.sql import functions as F

    placed = Table.of(df, position=[F.col("pos")])
    table = placed.with_df(placed.df.drop("pos"), cols=tuple(c for c in placed.cols if c.name != "pos"))
    return table, detect_types(table)


@pytest.mark.parametrize("name", CASES)
def test_proposal(typed, name):
    record = typed[1][name]
    assert (record.type, record.format, record.verdict) == CASES[name][1]


def test_findings_beside_the_proposal(typed):
    typing = typed[1]
    assert typing["two units"].mixed_affixes == ("€", "$")
    assert typing["mixed pairs"].mixed_boolean_pairs == ("true/false", "ja/nein")
    assert (typing["percent"].affix, typing["percent"].unparsed) == ("%", 1)
    assert typing["hours"].evidence == {
        "over": "kind", "alternatives": ["duration", "time"], "decidedBy": 1, "contested": 0}
    open_columns = typing.unresolved()
    with pytest.raises(R.Refused) as refusal:
        typing.confirm()
    assert refusal.value.diagnostics[0].values["columns"] == open_columns
    codes = {(d.values.get("column"), d.code) for d in typing.diagnostics()}
    assert ("clock", "typing.ambiguous_kind") in codes and ("day or month", "typing.ambiguous_locale") in codes


def answered(typing):
    for name, kind, fmt in (("thousands or decimals", "number", "de-DE"), ("day or month", "date", "MM.dd.yyyy"),
                            ("short open", "date", "dd.MM.yy"), ("short month first", "date", "MM.dd.yy"),
                            ("truncated iso", "date", "yy-MM-dd"), ("clock", "time", None)):
        typing = typing.choose(name, kind, fmt)
    return typing.confirm()


def test_conversion_agrees_with_detection_on_every_column(typed):
    table, typing = typed
    typing = answered(typing)
    out = convert(table, typing)
    data = out.ordered(companions=True).collect()
    for c in typing.columns:
        raw = out[c.name].raw
        assert (sum(r[raw] is not None for r in data) if raw else 0) == c.unparsed, c.name
        assert sum(r[c.name] is not None for r in data) == c.parsed, c.name
    cell = lambda name, i=0: data[i][name]
    assert [cell("accounting", i) for i in range(3)] == [-1234.56, -1000.0, 5.0]
    assert cell("german__raw", 19) == "abc" and cell("german", 19) is None
    assert [cell("dollars", i) for i in range(3)] == [-1234.56, 5.0, -3.1]
    assert cell("day or month") == dt.date(2025, 3, 4)
    assert cell("truncated iso") == dt.date(2025, 12, 31)
    assert cell("month names", 3) == dt.date(2026, 3, 2)
    assert [cell("iso", i) for i in range(3)] == [
        dt.datetime(2025, 12, 31, 12, 30), dt.datetime(2025, 12, 31, 14, 30, 0, 461000), dt.datetime(2026, 1, 1)]
    assert cell("german clock", 1) == dt.datetime(2025, 1, 2)
    assert cell("hours", 1) == 25 * 3600 * 10**9
    text = render_de(out).ordered().first()
    assert (text["accounting"], text["iso"], text["yes and no"], text["clock"]) == (
        "-1.234,56", "31.12.2025 12:30", "wahr", "09:05")


def test_choosing_a_type_leaves_open_what_nothing_decides(typed):
    typing = typed[1].choose("short open", "date")
    assert (typing["short open"].format, typing["short open"].verdict) == (None, "unresolved")
    assert typing.choose("leading zero", "number")["leading zero"].parsed == 2
    again = typing.annotate("german", "netto").choose("german", "text").carried_to(typed[1])
    assert (again["german"].type, again["german"].note, again.confirmed) == ("text", "netto", False)


def test_missing_tokens_are_part_of_the_typing(make):
    t = make("v string, w string", [("1", "1"), ("x", "x"), ("-", "-")])
    typing = detect_types(t, {"v": ("x", "-")})
    assert (typing["v"].type, typing["v"].missing, typing["w"].missing) == ("number", 2, 1)
    assert [r[0] for r in rows(convert(t, typing.confirm()))] == [1.0, None, None]


def test_typed_columns_box_what_is_not_finite(make):
    t = make("v double", [(1.0,), (float("nan"),), (float("inf"),), (None,)])
    typing = detect_types(t)
    assert (typing["v"].missing, typing["v"].unparsed) == (1, 2)
    assert rows(convert(t, typing.confirm()), True) == [(1.0, None), (None, "NaN"), (None, "Infinity"), (None, None)]
