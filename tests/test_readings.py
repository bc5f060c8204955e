"""Readings by way of Spark's own casts: whatever is no date, clock or number of the pattern stays unread."""

import datetime as dt

from pyspark.sql import functions as F

from tallysheaf.functions import clocks, dates, numbers


def test_readings_refuse_what_a_cast_would_take(spark):
    day = {"28.02.1900": dt.date(1900, 2, 28), "29.02.1900": None, "5 .04.1995": None, "1.4.1995": None, "05.04.1995 ": None, "05.04.1995T": None}
    short = {"01.02.29": dt.date(2029, 2, 1), "01.02.30": dt.date(1930, 2, 1), "31.04.95": None}
    at = {"1995-03-04T10:20": dt.datetime(1995, 3, 4, 10, 20), "1995-03-04T24:00+02:00": dt.datetime(1995, 3, 4, 22),
          "19950304t0059+0530": dt.datetime(1995, 3, 3, 19, 29), "19950304T102030,5Z": dt.datetime(1995, 3, 4, 10, 20, 30, 500000),
          "1995-03-04T9:20:30.123456789-01:30": dt.datetime(1995, 3, 4, 10, 50, 30, 123456), "1995-03-04T10:20-00:00": None,
          "1995-02-29T10:20": None, "1995-03-04T10:20 Europe/Berlin": None, "T10:20": None}
    number = {"-1.234,5": -1234.5, "(12)": -12.0, "12-": -12.0, "-0": 0.0, "1e5": None, "NaN": None, "12.34": None, "- 5": None}
    for want, read in ((day, lambda v: dates.parse_date(v, "dd.MM.yyyy")), (short, lambda v: dates.parse_date(v, "dd.MM.yy")),
                       (at, lambda v: clocks.parse_datetime(v, "ISO 8601")), (number, lambda v: numbers.parse_number(v, "de-DE", None, True))):
        df = spark.createDataFrame([(t,) for t in want], "t string")
        assert {r.t: r.v for r in df.select("t", read(F.col("t")).alias("v")).collect()} == want


def test_numeric_dates_and_clocks_are_cast_once(spark):
    """A reading's plan has one cast to its type, and no calendar of its own."""
    df = spark.createDataFrame([("04.03.1995", "1995-03-04T10:20Z")], "d string, t string")
    plan = df.select(dates.parse_date(F.col("d"), "dd.MM.yyyy"), clocks.parse_datetime(F.col("t"), "ISO 8601"))._jdf.queryExecution().analyzed().toString()
    assert "make_date" not in plan and "regexp_extract" not in plan
