"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheaf import report as R
from tallysheaf.functions import booleans, clocks, dates, numbers
from tallysheaf.functions.render import render_de
from tallysheaf.operators import filter as filtering
from tallysheaf.operators import first, join, profile, rank, search, tiles
from tallysheaf.operators.aggregate import aggregate
from tallysheaf.operators.columns import select_columns
from tallysheaf.operators.computed import add_computed
from tallysheaf.operators.sort import sort_rows
from tallysheaf.operators.union import union_tables
from tallysheaf.plans import contract as contracts
from tallysheaf.plans.convert import convert
from tallysheaf.plans.detect import detect_types, native_sweep
from tallysheaf.plans.recipe import FORMAT, run
from tallysheaf.sources import csv, encoding, sinks, workbooks
from tallysheaf.sources import json as json_source
from tallysheaf.sources.parquet import read_parquet
from tallysheaf.table import Table, col

from .inputs import boxed_prices, english, exports, frame, german, report_text, scratch, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def pick(t: Table, *names: str, **renamed: str) -> Table:
    """``pick(t, "a", new="old")``"""
    return select_columns(t, [*({"from": n} for n in names), *({"from": o, "to": n} for n, o in renamed.items())])


def cond(column: str, op: str, value=None) -> dict:
    return {"column": column, "op": op} if value is None else {"column": column, "op": op, "value": value}


def key(left: str, right: str | None = None) -> dict:
    return {"left": left, "right": right or left}


# ---- filter and columns ----------------------------------------------------------------------------------------


@query
def filter_all(spark, sf):
    t = filtering.filter_rows(table(spark, sf, "lineitem"), [
        cond("l_quantity", "gte", 30), cond("l_discount", "lt", 0.05), cond("l_returnflag", "ne", "R"),
        cond("l_shipdate", "gt", "1995-06-30T00:00:00")])
    return frame(pick(t, "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"))


@query
def filter_any(spark, sf):
    t = filtering.filter_rows(table(spark, sf, "lineitem"), [
        cond("l_quantity", "eq", 50), cond("l_tax", "lte", 0.0), cond("l_linestatus", "gt", "O")], "any")
    return frame(pick(t, "l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_linestatus"))


def _gappy(spark, sf) -> Table:
    """events with missing, empty and whitespace-only notes."""
    t = table(spark, sf, "events")
    note = (F.when(F.col("event_type") == "error", None).when(F.col("event_type") == "click", "")
            .when(F.col("user_id") % 2 == 0, "   ").otherwise(F.col("props")))
    kept = pick(t, "event_id", "event_type", "user_id", "props")
    df = kept.df.withColumn("note", note)
    return Table.of(df.select("event_id", "note", *[k.name for k in t.order])).with_df(
        df, order=t.order)


@query
def filter_empty(spark, sf):
    return frame(pick(filtering.filter_rows(_gappy(spark, sf), [cond("note", "empty")]), "event_id"))


@query
def filter_not_empty(spark, sf):
    return frame(filtering.filter_rows(_gappy(spark, sf), [cond("note", "not_empty")]))


@query
def filter_contains(spark, sf):
    t = filtering.filter_rows(table(spark, sf, "part"), [cond("p_name", "contains", "ring")])
    return frame(pick(t, "p_partkey", "p_name"))


@query
def filter_counts(spark, sf):
    return filtering.filter_counts(table(spark, sf, "lineitem"), [cond("l_quantity", "gt", 45)])


@query
def filter_boxed(spark, sf):
    """Under ``any`` a boxed price matches nothing, but the size may still keep its row."""
    t = filtering.filter_rows(
        boxed_prices(spark, sf), [cond("price_de", "lt", 20000), cond("size", "eq", "groß")], "any")
    return frame(t)


@query
def filter_boxed_counts(spark, sf):
    return filtering.filter_counts(
        boxed_prices(spark, sf), [cond("price_de", "lt", 20000), cond("size", "eq", "groß")])


@query
def select_rename(spark, sf):
    return frame(select_columns(table(spark, sf, "orders"), [
        {"from": "o_totalprice", "to": "total"}, {"from": "o_orderkey"}, {"from": "o_orderkey", "to": "again"}]))


# ---- order -----------------------------------------------------------------------------------------------------


@query
def sort_first(spark, sf):
    t = sort_rows(table(spark, sf, "lineitem"), [
        {"column": "l_extendedprice", "direction": "desc"}, {"column": "l_orderkey"}, {"column": "l_linenumber"}])
    return frame(pick(first.first_rows(t, 100), "l_orderkey", "l_linenumber", "l_extendedprice"))


@query
def sort_last(spark, sf):
    t = sort_rows(table(spark, sf, "lineitem"), [
        {"column": "l_shipdate"}, {"column": "l_orderkey"}, {"column": "l_linenumber", "direction": "desc"}])
    return frame(pick(first.first_rows(t, 100, "last"), "l_orderkey", "l_linenumber", "l_shipdate"))


@query
def sort_stable(spark, sf):
    """Ties on the key keep the file's order; the first sort is refined, not replaced."""
    t = sort_rows(table(spark, sf, "lineitem"), [{"column": "l_returnflag"}])
    t = sort_rows(t, [{"column": "l_quantity", "direction": "desc"}])
    return frame(pick(first.first_rows(t, 500), "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"))


@query
def sort_empty_last(spark, sf):
    """Descending, and the missing values still come last: the last rows are all of them."""
    joined = join.join_tables(table(spark, sf, "documents"), table(spark, sf, "labels"), [key("doc_id")])
    t = sort_rows(joined, [{"column": "quality", "direction": "desc"}, {"column": "doc_id"}])
    return frame(pick(first.first_rows(t, 50, "last"), "doc_id", "quality"))


def _words(spark, sf) -> Table:
    t = table(spark, sf, "documents")
    kept = pick(t, "doc_id", "text")
    df = kept.df.withColumn("word", F.regexp_extract("text", r"([^\s.,]+)[.,]?\s*$", 1)).drop("text")
    return Table.of(df.select("doc_id", "word")).with_df(df, order=t.order)


@query
def sort_collate_de(spark, sf):
    """German collation over the last word of every document, umlauts beside their base letters."""
    t = sort_rows(_words(spark, sf), [{"column": "word"}, {"column": "doc_id"}])
    return frame(first.first_rows(t, 300))


@query
def row_window(spark, sf):
    t = sort_rows(table(spark, sf, "orders"), [{"column": "o_totalprice"}, {"column": "o_orderkey"}])
    window, _ = first.row_window(pick(t, "o_orderkey", "o_totalprice"), 200, 50)
    return window


@query
def preview_counts(spark, sf):
    return first.preview(table(spark, sf, "orders"))[1]


@query
def sort_boxes_last(spark, sf):
    """Boxed cells stand with the empty ones behind every value, in either direction."""
    t = sort_rows(boxed_prices(spark, sf), [
        {"column": "price_de", "direction": "desc"}, {"column": "order_no"}, {"column": "line"}])
    return frame(first.first_rows(t, 200, "last"))


@query
def sort_full_rank(spark, sf):
    """Every line item with its position in a sort of the whole table."""
    t = sort_rows(table(spark, sf, "lineitem"), [
        {"column": "l_shipdate", "direction": "desc"}, {"column": "l_orderkey"}, {"column": "l_linenumber"}])
    return rank.with_rank(pick(t, "l_orderkey", "l_linenumber", "l_shipdate"))


@query
def collation_full_rank(spark, sf):
    """Every document's position by the German collation of its last word."""
    return rank.with_rank(sort_rows(_words(spark, sf), [{"column": "word"}, {"column": "doc_id"}]))


@query
def window_deep(spark, sf):
    """The rows in the middle of a sorted table, reached by their positions."""
    t = sort_rows(table(spark, sf, "lineitem"), [{"column": "l_extendedprice", "direction": "desc"}, {"column": "l_orderkey"}, {"column": "l_linenumber"}])
    half = t.df.count() // 2
    whole = rank.ranked(pick(t, "l_orderkey", "l_linenumber", "l_extendedprice"))
    return whole.df.where((F.col(rank.RANK) >= half) & (F.col(rank.RANK) < half + 5000)).select(
        "l_orderkey", "l_linenumber", "l_extendedprice", (F.col(rank.RANK) - half).alias("place"))


@query
def boxed_rows_last(spark, sf):
    """How many rows of a sort stand last because their cell could not be read."""
    report = R.Report("s")
    sort_rows(boxed_prices(spark, sf), [{"column": "price_de"}], report)
    return R.diagnostics_frame(spark, report.diagnostics()).select("severity", "code", F.col("values")["rows"].cast("bigint").alias("rows"))


# ---- union -----------------------------------------------------------------------------------------------------

_PARTIES = [{"target": "key", "from": "c_custkey"}, {"target": "key", "from": "s_suppkey"},
            {"target": "name", "from": "c_name"}, {"target": "name", "from": "s_name"},
            {"target": "balance", "from": "c_acctbal"}, {"target": "balance", "from": "s_acctbal"}]


@query
def union_keep(spark, sf):
    return frame(union_tables([table(spark, sf, "customer"), table(spark, sf, "supplier")], _PARTIES))


@query
def union_drop(spark, sf):
    return frame(union_tables([table(spark, sf, "customer"), table(spark, sf, "supplier")], _PARTIES, "drop"))


@query
def union_per_column(spark, sf):
    return frame(union_tables(
        [table(spark, sf, "customer"), table(spark, sf, "supplier")], _PARTIES,
        {"c_mktsegment": "keep", "c_nationkey": "drop", "s_nationkey": "drop"}))


@query
def union_boxes(spark, sf):
    """A companion only one input has is filled for the others."""
    boxed = pick(boxed_prices(spark, sf), "order_no", price="price_de")
    plain = table(spark, sf, "orders")
    plain = Table.of(plain.df.select(
        F.col("o_orderkey").cast("string").alias("order_no"), F.col("o_totalprice").alias("price"),
    ))
    return frame(union_tables([Table.of(boxed.frame(companions=True)), plain]))


@query
def union_partial_columns(spark, sf):
    from tallysheaf.operators.union import partial_columns

    found = partial_columns([table(spark, sf, "customer"), table(spark, sf, "supplier")], _PARTIES)
    rows = [(name, ",".join(map(str, at))) for name, at in found.items()]
    have = spark.createDataFrame(rows, "column string, slots string")
    total = union_tables([table(spark, sf, "customer"), table(spark, sf, "supplier")], _PARTIES).df.count()
    return have.withColumn("rows", F.lit(total).cast("bigint"))


# ---- join ------------------------------------------------------------------------------------------------------


@query
def join_left(spark, sf):
    t = join.join_tables(table(spark, sf, "documents"), table(spark, sf, "labels"), [key("doc_id")])
    return frame(pick(t, "doc_id", "lang", "quality", "toxic"))


@query
def join_inner(spark, sf):
    t = join.join_tables(table(spark, sf, "orders"), table(spark, sf, "customer"), [key("o_custkey", "c_custkey")],
                         "inner")
    return frame(pick(t, "o_orderkey", "c_name", "c_mktsegment"))


@query
def join_heavy_keys(spark, sf):
    """A few rows against whole line items: seven keys hold them all and are dealt to several tasks each; a missing key is led
    past."""
    li = table(spark, sf, "lineitem")
    least = F.when(F.col("l_linenumber") < 7, F.col("l_linenumber"))
    few = Table.of(li.df.groupBy(least.alias("line")).agg(F.count(F.lit(1)).alias("n")))
    many = Table.of(li.df.select(least.alias("line"), "l_orderkey", "l_extendedprice"))
    heavy = join.heavy_keys(few, many, [key("line")], rows_a_task=1000)
    return frame(join.join_tables(few, many, [key("line")], heavy=heavy))


@query
def join_two_keys(spark, sf):
    """lineitem against its own per-part, per-supplier totals."""
    li = table(spark, sf, "lineitem")
    totals = aggregate(li, ["l_partkey", "l_suppkey"], [{"op": "sum", "column": "l_quantity", "as": "total"}])
    t = join.join_tables(li, totals, [key("l_partkey"), key("l_suppkey")])
    return frame(pick(t, "l_orderkey", "l_linenumber", "total"))


def _nulled_users(spark, sf) -> tuple[Table, Table]:
    """events counted per user, with a share of the user keys missing on both sides."""
    t = table(spark, sf, "events")
    user = F.when(F.col("user_id") % 5 != 0, F.col("user_id"))
    left = Table.of(t.df.select("event_id", user.alias("user"), "event_type"))
    right = aggregate(
        Table.of(t.df.where(F.col("event_type") == "error").select(user.alias("user"), "value")),
        ["user"], [{"op": "count", "as": "errors"}])
    return left, right


@query
def join_nulls_apart(spark, sf):
    left, right = _nulled_users(spark, sf)
    return frame(pick(join.join_tables(left, right, [key("user")]), "event_id", "user", "errors"))


@query
def join_nulls_match(spark, sf):
    left, right = _nulled_users(spark, sf)
    return frame(pick(join.join_tables(left, right, [key("user")], nulls_match=True), "event_id", "user", "errors"))


@query
def join_name_clash(spark, sf):
    c, s = (pick(table(spark, sf, n), **{"nation": f"{n[0]}_nationkey", "name": f"{n[0]}_name"})
            for n in ("customer", "supplier"))
    nations = pick(table(spark, sf, "nation"), nation="n_nationkey", name="n_name")
    c = join.join_tables(c, nations, [key("nation")])
    s = aggregate(s, ["nation"], [{"op": "count", "as": "name"}])
    return frame(join.join_tables(c, s, [key("nation")]))


@query
def join_boxed_keys(spark, sf):
    """Prices joined on themselves: a box finds no partner although its text would."""
    t = boxed_prices(spark, sf)
    per_price = aggregate(t, ["price_de"], [{"op": "count", "as": "same"}])
    return frame(pick(join.join_tables(t, per_price, [key("price_de")], nulls_match=True), "order_no", "line", "same"))


@query
def join_report(spark, sf):
    return join.join_counts(
        table(spark, sf, "customer"), table(spark, sf, "orders"), [key("c_custkey", "o_custkey")])


@query
def join_report_nulls(spark, sf):
    left, right = _nulled_users(spark, sf)
    return join.join_counts(left, right, [key("user")])


@query
def duplicate_audit(spark, sf):
    return join.duplicate_audit(
        table(spark, sf, "customer"), table(spark, sf, "orders"), [key("c_custkey", "o_custkey")])


# ---- aggregate and computed ------------------------------------------------------------------------------------


@query
def aggregate_all(spark, sf):
    t = aggregate(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], [
        {"op": "count", "as": "n"}, {"op": "count_distinct", "column": "l_partkey", "as": "parts"},
        {"op": "sum", "column": "l_quantity", "as": "quantity"},
        {"op": "average", "column": "l_quantity", "as": "mean_quantity"},
        {"op": "minimum", "column": "l_shipdate", "as": "first_ship"},
        {"op": "maximum", "column": "l_extendedprice", "as": "top_price"}])
    return frame(t)


@query
def aggregate_null_group(spark, sf):
    left, _ = _nulled_users(spark, sf)
    return frame(aggregate(left, ["user"], [
        {"op": "count", "as": "n"}, {"op": "minimum", "column": "event_type", "as": "first_type"}]))


@query
def aggregate_boxes(spark, sf):
    """Boxes are skipped by sum and maximum and counted by the row count."""
    t = aggregate(boxed_prices(spark, sf), ["size"], [
        {"op": "count", "as": "n"}, {"op": "sum", "column": "price_de", "as": "total"},
        {"op": "maximum", "column": "price_de", "as": "top"},
        {"op": "count_distinct", "column": "price_de", "as": "prices"}])
    return frame(t).withColumn("total", F.round("total", 2))


@query
def aggregate_boxed_key(spark, sf):
    """As a key each original text of a box is a group of its own."""
    t = aggregate(boxed_prices(spark, sf), ["price_de"], [{"op": "count", "as": "n"}])
    return frame(filtering.filter_rows(t, [cond("n", "gt", 1)]))


@query
def computed_arithmetic(spark, sf):
    t = table(spark, sf, "lineitem")
    for name, op, a, b in (("plus", "add", "l_quantity", "l_tax"), ("minus", "subtract", "l_quantity", "l_discount"),
                           ("times", "multiply", "l_extendedprice", "l_discount"),
                           ("per", "divide", "l_extendedprice", "l_quantity")):
        t = add_computed(t, name, op, [a, b])
    return pick(t, "l_orderkey", "l_linenumber", "plus", "minus", "times", "per").frame()


@query
def computed_marked_empty(spark, sf):
    """A zero divisor leaves a marked empty cell, told from a missing one by its companion."""
    t = add_computed(table(spark, sf, "lineitem"), "share", "ratio", ["l_tax", "l_discount"])
    return frame(pick(t, "l_orderkey", "l_linenumber", "share"))


@query
def computed_concat(spark, sf):
    t = add_computed(table(spark, sf, "part"), "label", "concat", ["p_brand", "p_type", "p_size"], " / ")
    return frame(pick(t, "p_partkey", "label"))


@query
def computed_date_diff(spark, sf):
    t = join.join_tables(table(spark, sf, "lineitem"), table(spark, sf, "orders"), [key("l_orderkey", "o_orderkey")])
    df = t.df.select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("shipped"),
                     F.to_date("o_orderdate").alias("ordered"))
    t = add_computed(Table.of(df), "days", "date_diff_days", ["shipped", "ordered"])
    return frame(pick(t, "l_orderkey", "l_linenumber", "days"))


@query
def computed_on_boxes(spark, sf):
    t = add_computed(boxed_prices(spark, sf), "double", "add", ["price_de", "price_de"])
    return frame(pick(t, "order_no", "line", "double"))


# ---- reading text ----------------------------------------------------------------------------------------------


@query
def parse_numbers(spark, sf):
    """Each price written in German, English, accounting and unit forms, read back."""
    price, odd = F.col("l_extendedprice"), F.col("l_linenumber") % 2 == 0
    de, en = german(price), english(price)
    text = {
        "de": (de, "de-DE", None, False), "en": (F.concat(F.lit("-"), en), "en-US", None, False),
        "paren": (F.concat(F.lit("("), de, F.lit(")")), "de-DE", None, True),
        "trailing": (F.when(odd, F.concat(de, F.lit("-"))).otherwise(de), "de-DE", None, True),
        "euro": (F.concat(de, F.lit(" €")), "de-DE", "€", False),
        "dollar": (F.concat(F.lit("-$"), en), "en-US", "$", False),
        "wrong": (en, "de-DE", None, False),
    }
    li = table(spark, sf, "lineitem")
    return li.df.select("l_orderkey", "l_linenumber", *[
        numbers.parse_number(t, loc, affix, acc).alias(n) for n, (t, loc, affix, acc) in text.items()])


@query
def parse_dates(spark, sf):
    """Each ship date written in all fourteen numeric patterns and read back; two-digit years through the pivot."""
    li = table(spark, sf, "lineitem")
    return li.df.select("l_orderkey", "l_linenumber", *[
        dates.parse_date(F.date_format("l_shipdate", k), k).alias(f"d{i}")
        for i, k in enumerate(dates.DATE_KEYS[:-1])])


@query
def parse_month_names(spark, sf):
    """Each ship date with its month written out, German and English, day first and month first."""
    ship = F.col("l_shipdate")
    names = F.array(*[F.lit(n) for n in ("Jan.", "Feb.", "März", "Apr.", "Mai", "Juni", "Juli", "Aug.", "Sept.",
                                         "Okt.", "Nov.", "Dez.")])
    german_day = F.concat(F.day(ship).cast("string"), F.lit(". "), F.get(names, F.month(ship) - 1), F.lit(" "),
                          F.year(ship).cast("string"))
    english_day = F.concat(F.date_format(ship, "MMMM"), F.lit(" "), F.day(ship).cast("string"), F.lit("th, "),
                           F.year(ship).cast("string"))
    li = table(spark, sf, "lineitem")
    return li.df.select(
        "l_orderkey", "l_linenumber",
        dates.parse_date(german_day, dates.MONTH_NAME).alias("de"),
        dates.parse_date(english_day, dates.MONTH_NAME).alias("en"),
        clocks.parse_datetime(F.concat(german_day, F.lit(" 4:05:06")), "month name and clock").alias("at"))


@query
def parse_datetimes(spark, sf):
    """Event times written as ISO with an offset, basic ISO, German and plain, read back to UTC."""
    ts = F.col("ts")
    iso = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("-05:30"))
    basic = F.concat(F.date_format(ts, "yyyyMMdd'T'HHmmss"), F.lit(",5Z"))
    events = table(spark, sf, "events")
    return events.df.select(
        "event_id",
        clocks.parse_datetime(iso, "ISO 8601").alias("iso"),
        clocks.parse_datetime(basic, "ISO 8601").alias("basic"),
        clocks.parse_datetime(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), "yyyy-MM-dd HH:mm").alias("plain"),
        clocks.parse_datetime(F.date_format(ts, "dd.MM.yyyy H:mm"), "dd.MM.yyyy HH:mm").alias("german"),
        clocks.parse_datetime(F.date_format(ts, "dd.MM.yy '24:00'"), "dd.MM.yy HH:mm").alias("next_day"))


@query
def parse_clocks(spark, sf):
    ts, events = F.col("ts"), table(spark, sf, "events")
    hours = F.concat((F.col("user_id") + 20).cast("string"), F.date_format(ts, ":mm:ss"))
    return events.df.select(
        "event_id", clocks.parse_time(F.date_format(ts, "H:mm:ss")).alias("time_ns"),
        clocks.parse_time(hours).alias("late_ns"), clocks.parse_duration(hours).alias("duration_ns"))


@query
def parse_booleans(spark, sf):
    flag, li = F.col("l_returnflag"), table(spark, sf, "lineitem")
    word = F.when(flag == "R", "WAHR").when(flag == "A", "falsch").otherwise("ja")
    return li.df.select(
        "l_orderkey", "l_linenumber", booleans.parse_boolean(word, "wahr/falsch").alias("wf"),
        booleans.parse_boolean(word, "ja/nein").alias("jn"))


@query
def detect_report_types(spark, sf):
    """The proposal for every column of the report export, from all of its values."""
    t = report_text(spark, sf)
    return detect_types(t).frame(spark).select(
        "column", "type", "format", "total", "missing", "parsed", "unparsed", "verdict", "affix")


@query
def detect_evidence(spark, sf):
    """What decides between two readings: the values only one of them can read."""
    t = report_text(spark, sf)
    return detect_types(t).frame(spark).select("column", F.array_join("alternatives", " | ").alias("alternatives"), "decided_by", "contested")


@query
def score_chosen_types(spark, sf):
    """The hit rate follows a chosen type at once, from the same scan."""
    typing = detect_types(report_text(spark, sf))
    for name, kind, fmt in (("price_de", "number", "en-US"), ("shipped_de", "date", "MM.dd.yyyy"),
                            ("returned", "boolean", None), ("article", "number", None), ("size", "number", "de-DE"),
                            ("shipped_us", "text", None), ("worked", "time", None)):
        typing = typing.choose(name, kind, fmt)
    return typing.frame(spark).select("column", "type", "parsed", "unparsed")


@query
def convert_report(spark, sf):
    """The report export under its confirmed typing; unreadable prices keep their text."""
    text = report_text(spark, sf)
    return frame(convert(text, detect_types(text).confirm()))


@query
def convert_clocks(spark, sf):
    picked = pick(report_text(spark, sf), "order_no", "line", "worked")
    return frame(convert(picked, detect_types(picked).choose("worked", "duration").confirm())).drop("worked__raw")


def _fine_clocks(spark, sf) -> Table:
    """Ship dates as text with seven to nine fraction digits, a few of them unreadable: pairs of values 100 ns apart."""
    t = table(spark, sf, "lineitem")
    digits = F.lpad((F.col("l_orderkey") % 4 * 100 + F.col("l_suppkey") % 3 * 7).cast("string"), 3, "0")
    at = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000001"), digits, F.lit("Z"))
    at = F.when(F.col("l_partkey") % 97 == 0, F.lit("unknown")).when(F.col("l_partkey") % 89 == 0, F.lit("n/a")).otherwise(at)
    df = t.df.select(F.col("l_orderkey").cast("string").alias("order_no"), F.col("l_linenumber").cast("string").alias("line"), at.alias("moment"), *[k.name for k in t.order])
    text = Table.of(df).with_df(df, order=t.order)
    return convert(text, detect_types(text).choose("order_no", "number").choose("line", "number").confirm())


@query
def datetime_nanos(spark, sf):
    """Groups by datetimes of nanoseconds: two 100 ns apart are two groups; their least and greatest, and how many differ."""
    t = _fine_clocks(spark, sf)
    out = aggregate(t, ["moment"], [{"op": "count"}, {"op": "minimum", "column": "order_no", "as": "first_order"}])
    return out.df.select("moment", F.col(out["moment"].nanos).alias("nanos"), F.col(out["moment"].raw).alias("text"), "count", "first_order")


@query
def datetime_nanos_filter(spark, sf):
    """Comparisons on either side of a value of nanoseconds, which reach the digits below the microsecond."""
    t, rows = _fine_clocks(spark, sf), []
    at = "1995-03-04T00:00:00.000001107"
    tests = [F.count(F.when(filtering.predicate(t, [cond("moment", op, at)]), 1)).alias(op) for op in ("eq", "ne", "lt", "lte", "gt", "gte")]
    return t.df.agg(*tests)


@query
def datetime_nanos_join(spark, sf):
    """A join on datetimes of nanoseconds, each against how often it occurs, and their extremes by line."""
    t = pick(_fine_clocks(spark, sf), "order_no", "line", "moment")
    times = aggregate(t, ["moment"], [{"op": "count", "as": "same"}])
    readable = filtering.filter_rows(times, [cond("moment", "not_empty")])
    readable = readable.with_df(readable.df.where(f"`{readable['moment'].raw}` IS NULL"))
    joined = join.join_tables(t, readable, [key("moment")])
    ends = aggregate(joined, ["line"], [
        {"op": "minimum", "column": "moment", "as": "first"}, {"op": "maximum", "column": "moment", "as": "last"},
        {"op": "count_distinct", "column": "moment", "as": "different"}, {"op": "sum", "column": "same", "as": "pairs"}])
    return frame(render_de(ends))


@query
def parquet_nanos(spark, sf):
    """Datetimes of nanoseconds through Parquet files whose footers alone tell what they are."""
    path = scratch(spark, "nanos")
    t = table(spark, sf, "events")

    def write(batches):
        import pyarrow as pa
        import pyarrow.fs
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        rows = pa.Table.from_batches(batches, pa.schema([("event_id", pa.int64()), ("moment", pa.int64())]))
        system, folder = (pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path.removeprefix("file:")))
        system.create_dir(folder)
        # Named by the task: one that runs again writes the same file again.
        name = f"{folder}/part-{TaskContext.get().partitionId()}.parquet"
        pq.write_table(rows.set_column(1, "moment", rows["moment"].cast(pa.timestamp("ns"))), name, filesystem=system)
        yield pa.RecordBatch.from_arrays([pa.array([rows.num_rows])], names=["rows"])

    nanos = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000
    t.df.select("event_id", nanos.alias("moment")).mapInArrow(write, "rows long").agg(F.sum("rows")).first()
    read, _ = read_parquet(spark, path)
    return read.df.select("event_id", "moment", F.col(read["moment"].nanos).alias("nanos"))


@query
def render_german(spark, sf):
    return frame(render_de(table(spark, sf, "lineitem")))


@query
def render_boxes(spark, sf):
    return frame(render_de(pick(boxed_prices(spark, sf), "order_no", "line", "price_de")))


@query
def sweep_typed_columns(spark, sf):
    t = table(spark, sf, "customer")
    broken = t.df.withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 0, F.lit(float("nan")))
                             .when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")))
    return native_sweep(Table.of(broken.select("c_custkey", "c_acctbal", "c_nationkey")),
                        ["c_custkey", "c_acctbal", "c_nationkey"])


# ---- profile, search, tiles, contract --------------------------------------------------------------------------


@query
def search_positions(spark, sf):
    """Every cell of the documents with a 1 in it, as it reads on screen: its row, its column and its number among the hits."""
    t = sort_rows(table(spark, sf, "documents"), [{"column": "doc_id"}])
    return search.search_positions(t, "1")


@query
def column_profile(spark, sf):
    t = join.join_tables(table(spark, sf, "documents"), table(spark, sf, "labels"), [key("doc_id")])
    return profile.column_profile(t, "documents").select(
        "source", "rows", "column", "type", "distinct_values", "null_share")


@query
def sample_values(spark, sf):
    return profile.sample_values(table(spark, sf, "part"), ["p_brand", "p_size"], 3)


@query
def search_rows(spark, sf):
    found = search.search(table(spark, sf, "part"), "12")
    return found.df.select("p_partkey", F.array_join("matched_columns", ",").alias("matched"))


@query
def search_counts(spark, sf):
    return search.search_counts(table(spark, sf, "documents"), "the")


@query
def tile_top_n(spark, sf):
    t = tiles.top_n(table(spark, sf, "lineitem"), "l_suppkey", "sum", "l_quantity", 10)
    return frame(t)


@query
def tile_bottom_n(spark, sf):
    return frame(tiles.bottom_n(table(spark, sf, "lineitem"), "l_suppkey", "count", None, 10))


@query
def tile_line(spark, sf):
    return frame(tiles.line(table(spark, sf, "orders"), "o_orderdate", "count", None, 60))


@query
def tile_key_figure(spark, sf):
    return frame(tiles.key_figure(table(spark, sf, "lineitem"), "sum", "l_quantity"))


@query
def preflight_scores(spark, sf):
    """A contract checked against the report export: fits, doubtful with the hit rate, missing."""
    need = contracts.Requirement
    typing = detect_types(report_text(spark, sf))
    check = contracts.preflight([
        need("report", "price_de", "number", "de-DE"), need("report", "price_en", "number", "de-DE"),
        need("report", "shipped_de", "date", "dd.MM.yyyy"), need("report", "shipped_us", "date", "MM/dd/yyyy"),
        need("report", "size"), need("report", "Preis", "number", "de-DE"), need("report", "extra", optional=True),
    ], {"report": typing})
    return check.frame(spark).select("column", "verdict", "hit_rate")


@query
def map_columns(spark, sf):
    t = pick(table(spark, sf, "customer"), "c_custkey", "c_name")
    return frame(contracts.map_columns(t, {"c_custkey": "Kundennr", "c_name": "Name"}))


# ---- recipes ---------------------------------------------------------------------------------------------------


def recipe() -> dict:
    """Large orders per segment and nation: union, join, filter, computed, aggregate, sort, first."""
    return {
        "format": FORMAT, "name": "Large orders by segment",
        "sources": [{"id": s, "name": s, "file": f"{s}.parquet"} for s in ("orders", "customer", "nation")],
        "steps": [
            {"id": "open", "kind": "filter", "inputs": "orders", "config": {
                "combine": "all", "conditions": [cond("o_orderstatus", "eq", "O")]}},
            {"id": "done", "kind": "filter", "inputs": "orders", "config": {
                "combine": "all", "conditions": [cond("o_orderstatus", "eq", "F")]}},
            {"id": "both", "kind": "union", "inputs": ["open", "done"], "config": {"mappings": [], "unmatched": "keep"}},
            {"id": "big", "kind": "filter", "inputs": "both", "config": {
                "combine": "all", "conditions": [cond("o_totalprice", "gt", "100000")]}},
            {"id": "who", "kind": "join", "inputs": ["big", "customer"], "config": {
                "keys": [key("o_custkey", "c_custkey")], "type": "left", "nullsMatch": False, "duplicateAudit": False}},
            {"id": "where", "kind": "join", "inputs": ["who", "nation"], "config": {
                "keys": [key("c_nationkey", "n_nationkey")], "type": "inner"}},
            {"id": "sums", "kind": "aggregate", "inputs": "where", "config": {
                "by": ["c_mktsegment", "n_name"], "aggs": [
                    {"op": "count", "as": "orders"}, {"op": "sum", "column": "o_totalprice", "as": "total"}]}},
            {"id": "mean", "kind": "computed", "inputs": "sums", "config": {
                "name": "mean", "op": "divide", "inputs": ["total", "orders"]}},
            {"id": "ranked", "kind": "sort", "inputs": "mean", "config": {
                "keys": [{"column": "orders", "direction": "desc"}, {"column": "c_mktsegment"}, {"column": "n_name"}]}},
            {"id": "top", "kind": "first", "inputs": "ranked", "config": {"count": 40}},
            {"id": "named", "kind": "columns", "inputs": "top", "config": {"columns": [
                {"from": "c_mktsegment", "to": "segment"}, {"from": "n_name", "to": "nation"}, {"from": "orders"},
                {"from": "total"}, {"from": "mean"}]}},
            {"id": "orphan", "kind": "sort", "inputs": "orders", "config": {"keys": []}},
        ],
        "result": "named",
    }


def _sources(spark, sf):
    return {s: table(spark, sf, s) for s in ("orders", "customer", "nation")}


@query
def recipe_end_to_end(spark, sf):
    t = run(recipe(), _sources(spark, sf), counts=False).table
    return t.frame().withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean"))


@query
def recipe_report(spark, sf):
    """What each step of the recipe did to the rows."""
    outcome = run(recipe(), _sources(spark, sf))
    found = R.diagnostics_frame(spark, outcome.report.diagnostics())
    return found.select("step", "severity", "code", F.explode("values").alias("name", "value"))


@query
def run_status(spark, sf):
    outcome = run(recipe(), _sources(spark, sf))
    status = outcome.status()
    return spark.createDataFrame(
        [(s, n, status["clean"]) for s, n in status["counts"].items()], "severity string, n bigint, clean boolean")


@query
def recipe_contract(spark, sf):
    """Only the columns the recipe reads, with their types."""
    typings = {s: detect_types(t) for s, t in _sources(spark, sf).items()}
    rows = [(r.source, r.column, r.type) for r in contracts.derive_contract(recipe(), typings)]
    return spark.createDataFrame(rows, "source string, column string, type string")


# ---- sources and sinks -----------------------------------------------------------------------------------------


def _damaged_csv(spark, sf) -> str:
    """orders as German CSV exports with short and long records."""
    t, path = table(spark, sf, "orders"), scratch(spark, "orders-csv")
    line = F.concat_ws(
        ";", F.col("o_orderkey").cast("string"), german(F.floor("o_totalprice"), 0),
        F.date_format("o_orderdate", "dd.MM.yyyy"), F.concat(F.lit('"Prio; '), F.col("o_orderpriority"), F.lit('"')),
        F.col("o_custkey").cast("string"), F.col("o_orderstatus"))
    line = F.when(F.col("o_orderkey") % 101 == 0, F.concat(line, F.lit(";zuviel"))).when(
        F.col("o_orderkey") % 103 == 0, F.substring_index(line, ";", 2)).otherwise(line)
    return exports(t.df.select(line.alias("value")), "Nr;Betrag;Datum;Priorität;Kunde;Status", path)


@query
def csv_read(spark, sf):
    """Delimiter, header and encoding proposed; damaged records set aside; the rest typed from all values."""
    source = csv.read_csv(spark, _damaged_csv(spark, sf))
    # Whole amounts with a group mark read either way: the one question a person has to answer.
    typing = detect_types(source.table).choose("Betrag", "number", "de-DE")
    return frame(convert(source.table, typing.confirm()))


@query
def csv_quarantine(spark, sf):
    source = csv.read_csv(spark, _damaged_csv(spark, sf))
    return source.quarantine.select("fields", "raw", "reason")


@query
def csv_malformed_rows(spark, sf):
    """Every record with a field that goes on after its closing quote, however many there are."""
    t, path = table(spark, sf, "lineitem"), scratch(spark, "malformed")
    name = F.concat(F.lit('"'), F.col("l_orderkey").cast("string"), F.lit('"'))
    name = F.when(F.col("l_orderkey") % 7 == 0, F.concat(name, F.lit("x"))).otherwise(name)
    line = F.concat_ws(",", name, F.col("l_linenumber").cast("string"), F.col("l_returnflag"))
    source = csv.read_csv(spark, exports(t.df.select(line.alias("value")), "Nr,Zeile,Art", path), delimiter=",", header_row=1)
    return source.malformed.select("fields", "raw", "reason")


@query
def unique_columns(spark, sf):
    """A header with blank and repeated names: every column keeps its cells under a name of its own."""
    t, path = table(spark, sf, "customer"), scratch(spark, "names")
    line = F.concat_ws(";", F.col("c_custkey").cast("string"), "c_name", F.col("c_nationkey").cast("string"), "c_mktsegment")
    source = csv.read_csv(spark, exports(t.df.select(line.alias("value")), "Nr;;Nr;col_2", path), delimiter=";", header_row=1)
    return source.table.frame()


@query
def csv_utf16(spark, sf):
    """UTF-16 read in splits: characters whose halves look like a line feed are no line feeds."""
    t, path = table(spark, sf, "part"), scratch(spark, "parts-utf16")
    name = F.concat("p_name", F.lit("\u0a0a\u0100 \u000a\u0a00"))
    rows = t.df.select(F.col("p_partkey").cast("string").alias("Nr"), F.translate(name, "\n", "-").alias("Name"), "p_brand")
    rows.write.option("encoding", "UTF-16LE").option("header", True).csv(path, sep=";", quote="")
    source = csv.read_csv(spark, path, encoding=encoding.UTF16LE)
    return source.table.frame().select(F.col("Nr").cast("bigint"), "Name", "p_brand")


@query
def json_document(spark, sf):
    """orders as arrays over many lines, taken apart in splits."""
    t, path = table(spark, sf, "orders"), scratch(spark, "orders-document")
    text = F.regexp_replace(F.to_json(F.struct("o_orderkey", F.struct("o_custkey", "o_orderpriority").alias("of"), "o_totalprice")), ",", ",\n  ")
    placed = t.df.select(text.alias("value"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    first = placed.groupBy("p").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    lines = placed.join(first, "p").select(
        F.concat(F.when(F.col("i") == F.col("first"), "[\n").otherwise(","), "value", F.when(F.col("i") == F.col("last"), "\n]").otherwise("")).alias("value"), "p", "i")
    lines.repartition("p").sortWithinPartitions("p", "i").select("value", "p").write.partitionBy("p").text(path)
    return json_source.read_json(spark, path)[0].frame().select(
        "o_orderkey", F.col("`of.o_custkey`").alias("o_custkey"), F.col("`of.o_orderpriority`").alias("o_orderpriority"), "o_totalprice")


@query
def csv_proposals(spark, sf):
    path = _damaged_csv(spark, sf)
    delimiters = csv.propose_delimiters(spark, path)
    headers = csv.propose_header_rows(csv.records(spark, path, ";"))
    kinds = encoding.detect_encodings(spark, path)
    found = delimiters.join(headers, "file").join(kinds, "file")
    return found.select("delimiter", "header_line", "fields", "encoding", "decided_by", "nul_bytes").distinct()


@query
def csv_line_breaks(spark, sf):
    """Conversations as quoted fields full of line breaks, delimiters and quotes, stitched back over all splits."""
    path = scratch(spark, "conversations-csv")
    t = table(spark, sf, "conversations")
    cell = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", cell)
    exports(t.df.select(line.alias("value")), "conv_id,turn,role,text", path)
    body = csv.read_csv(spark, path).table.frame()
    return body.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", F.md5("text").alias("text_md5"))


def _accented(spark, sf) -> DataFrame:
    flat = F.trim(F.regexp_replace("text", r"[\s\x00-\x1f]+", " "))
    # What windows-1252 cannot write becomes a question mark; every document is written whole.
    return table(spark, sf, "documents").df.select("doc_id", F.regexp_replace(flat, r"[^ -~À-ÿ]", "?").alias("value"))


def _two_encodings(spark, sf) -> str:
    """Accented documents written once as UTF-8 and once as windows-1252."""
    base, flat = scratch(spark, "documents-text"), _accented(spark, sf).select("value")
    flat.write.text(f"{base}/utf8")
    flat.write.option("encoding", "ISO-8859-1").csv(f"{base}/cp1252", sep="\u0001", quote="", emptyValue="")
    return base


@query
def encoding_detected(spark, sf):
    """The same documents in two encodings, told apart by their bytes."""
    base = _two_encodings(spark, sf)
    return encoding.detect_encodings(spark, [f"{base}/utf8", f"{base}/cp1252"]).select(
        F.regexp_extract("file", r"/(utf8|cp1252)/", 1).alias("written_as"), "encoding", "decided_by", "nul_bytes"
    ).distinct()


@query
def encoding_decoded(spark, sf):
    """What either encoding decodes to is the same text."""
    base = _two_encodings(spark, sf)
    both = [csv.raw_lines(spark, f"{base}/{folder}", kind) for folder, kind in (
        ("utf8", encoding.UTF8), ("cp1252", encoding.CP1252))]
    return both[0].unionByName(both[1]).groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n"))


@query
def nul_bytes(spark, sf):
    """UTF-16 without its mark passes for UTF-8, and leaves a NUL behind every character."""
    path = scratch(spark, "regions-utf16")
    t = table(spark, sf, "part")
    t.df.select("p_name").write.option("encoding", "UTF-16LE").csv(path, sep="\u0001", quote="")
    return encoding.nul_bytes(spark, path).agg(F.sum("nul_bytes").alias("nul_bytes"))


@query
def json_flattened(spark, sf):
    """events as nested line-delimited JSON, read back with dot-path names and arrays as JSON text."""
    return _nested_json(spark, sf, "json").select(
        "event_id", F.col("`who.id`").alias("who_id"), F.col("`who.kind`").alias("who_kind"), "values")


@query
def json_indexed(spark, sf):
    return _nested_json(spark, sf, "index").select(
        "event_id", F.col("`values.0`").alias("v0"), F.col("`values.1`").alias("v1"))


@query
def json_exploded(spark, sf):
    return _nested_json(spark, sf, "explode").select("event_id", F.col("values").alias("v"))


def _nested_json(spark, sf, arrays) -> DataFrame:
    path = scratch(spark, "events-json")
    t = table(spark, sf, "events")
    t.df.select(
        "event_id", F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("kind")).alias("who"),
        F.when(F.col("event_id") % 3 == 0, F.array().cast("array<double>"))
        .when(F.col("event_id") % 3 == 1, F.array("value"))
        .otherwise(F.array(F.col("value"), F.col("value") + 1)).alias("values"),
    ).write.json(path)
    return json_source.read_json(spark, path, arrays=arrays)[0].frame()


@query
def json_shapes(spark, sf):
    """Line-delimited files, whole documents and broken files, told apart by a strict parse."""
    base, t = scratch(spark, "shapes"), table(spark, sf, "nation")
    one = F.to_json(F.struct("n_nationkey", "n_name"))
    t.df.select(one.alias("value")).write.text(f"{base}/kind=ndjson")
    t.df.select(F.concat(F.lit("[\n"), one, F.lit("\n,"), one, F.lit("]")).alias("value")).repartition(
        25, "value").write.option("maxRecordsPerFile", 1).text(f"{base}/kind=document")
    t.df.select(F.concat(F.lit("{'n': \n"), one).alias("value")).write.option("maxRecordsPerFile", 1).text(
        f"{base}/kind=malformed")
    return json_source.json_shapes(spark, f"{base}/*").groupBy(
        F.regexp_extract("file", "kind=([a-z]+)", 1).alias("written_as"), "shape").agg(
        F.count(F.lit(1)).alias("files")).select(
        "written_as", "shape", F.when(F.col("shape") != "ndjson", F.col("files")).alias("files"))


def _damaged_events(spark, sf) -> str:
    """events, a line each, of which every seventh is cut short, runs on after its value or has a comma too many."""
    path = scratch(spark, "events-damaged")
    whole = F.to_json(F.struct("event_id", "event_type", "props"))
    body = F.substring(whole, F.lit(1), F.char_length(whole) - 1)
    damaged = F.when(F.col("event_id") % 3 == 0, body).when(F.col("event_id") % 3 == 1, F.concat(whole, whole)).otherwise(F.concat(body, F.lit(",}")))
    lines = table(spark, sf, "events").df.select("event_id", F.when(F.col("event_id") % 7 == 3, damaged).otherwise(whole).alias("value"))
    lines.select(F.col("value")).write.text(path)
    return path


@query
def json_set_aside(spark, sf):
    """The whole lines of damaged files, read; damaged ones left to the quarantine."""
    read, found = json_source.read_json(spark, _damaged_events(spark, sf), set_aside=True)
    return read.frame().select("event_id", "event_type", "props", F.lit(found[0].values["lines"]).cast("bigint").alias("lines_set_aside"))


@query
def json_quarantine(spark, sf):
    return json_source.json_quarantine(spark, _damaged_events(spark, sf)).select("raw")


@query
def json_repaired(spark, sf):
    """The quarantine read again on request: a comma too many is repaired, cut lines and second values stay set aside."""
    aside = json_source.json_quarantine(spark, _damaged_events(spark, sf))
    again = json_source.reread_lenient(aside, "event_id bigint, event_type string, props string")
    return again.select("before", "repaired", F.col("value.event_id").alias("event_id"), F.col("value.props").alias("props"))


@query
def json_reread_all(spark, sf):
    """The whole quarantine read again: lines of two values stay set aside with the cut ones."""
    again = json_source.reread_lenient(json_source.json_quarantine(spark, _damaged_events(spark, sf)),
                                       "event_id bigint, event_type string, props string")
    return again.select("before", "repaired", F.col("value.event_id").alias("event_id"), F.col("value.props").alias("props"))


@query
def json_lenient(spark, sf):
    """events as a model would paste them - fences, trailing commas, comments, loose quotes - read on request."""
    t = table(spark, sf, "events")
    body = F.concat(F.lit("{id: "), F.col("event_id").cast("string"), F.lit(", 'kind': '"), F.col("event_type"),
                    F.lit("', /* note */ \"props\": "), F.to_json(F.struct("props")), F.lit(",}"))
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(
        F.col("event_id") % 11 == 0, F.substring(body, 1, 20)).otherwise(body)
    out = json_source.reread_lenient(
        t.df.select("event_id", raw.alias("raw")), "id bigint, kind string, props struct<props:string>")
    return out.select("event_id", "changed", "repaired", F.col("value.id").alias("id"), F.col("value.kind").alias("kind"),
                      F.col("value.props.props").alias("props"))


@query
def parquet_non_finite(spark, sf):
    """Balances of which some are not finite: boxed on reading, so that comparisons and sums pass them by."""
    path = scratch(spark, "non-finite")
    odd = F.when(F.col("c_custkey") % 10 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 10 == 1, F.lit(float("-inf")))
    table(spark, sf, "customer").df.select("c_custkey", F.coalesce(odd, F.col("c_acctbal")).alias("c_acctbal")).write.parquet(path)
    read, found = read_parquet(spark, path)
    kept = filtering.filter_rows(read, [cond("c_acctbal", "gt", 0)])
    above = kept.df.agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("s"))
    return read.df.groupBy("c_acctbal__raw").agg(F.count(F.lit(1)).alias("rows"), F.max("c_acctbal").alias("most")).join(
        F.broadcast(above), F.col("c_acctbal__raw").isNull(), "left").select(
        "c_acctbal__raw", "rows", "most", "n", F.round("s", 2).alias("s"), F.lit(found[0].values["count"]).cast("bigint").alias("boxed"))


@query
def parquet_types(spark, sf):
    """The seven kinds a file's own types arrive as; a nested column arrives as JSON text."""
    rows = []
    for name in ("lineitem", "orders", "events", "embeddings", "customer"):
        t, _ = read_parquet(spark, f"{sf}/{name}.parquet")
        rows += [(name, c.name, c.kind) for c in t.cols]
    kinds = spark.createDataFrame(rows, "table string, column string, kind string")
    dims = read_parquet(spark, f"{sf}/embeddings.parquet")[0].df.agg(
        F.min(F.size(F.from_json("embedding", "array<double>")))).first()[0]
    return kinds.withColumn("dims", F.lit(dims))


@query
def parquet_round_trip(spark, sf):
    """Written with boxes, read back with columns, kinds and boxes intact."""
    path = scratch(spark, "boxed")
    sinks.write_parquet(boxed_prices(spark, sf), path)
    return frame(read_parquet(spark, path)[0])


@query
def csv_round_trip(spark, sf):
    """Written in German conventions, read back by proposal."""
    path = scratch(spark, "export")
    sinks.write_csv(table(spark, sf, "customer"), path)
    source = csv.read_csv(spark, path)
    typing = detect_types(source.table)
    for name in ("c_custkey", "c_nationkey", "c_acctbal"):
        typing = typing.choose(name, "number", "de-DE")
    return frame(convert(source.table, typing.confirm()))


@query
def json_round_trip(spark, sf):
    path = scratch(spark, "export-json")
    sinks.write_json(table(spark, sf, "customer"), path)
    return frame(json_source.read_json(spark, path)[0])


@query
def workbook_read(spark, sf):
    """customers as workbooks of a thousand rows each, opened one per task and pivoted back."""
    from .books import customer_book

    t = table(spark, sf, "customer")
    files = t.df.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", (F.col("c_custkey") / 1000).cast("bigint").alias("book")) \
        .groupBy("book").applyInPandas(customer_book, "path string, content binary")
    return frame(workbooks.read_workbooks(files).table)
