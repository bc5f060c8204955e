"""The inputs of the registered queries: the given tables as pipeline tables, and report text rendered from them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheaf.plans.session import tune
from tallysheaf.plans.storage import shared_folder
from tallysheaf.sources.parquet import read_parquet
from tallysheaf.table import Table


def table(spark: SparkSession, sf: str, name: str) -> Table:
    return read_parquet(tune(spark), f"{sf}/{name}.parquet")[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def german(value: Column, decimals: int = 2) -> Column:
    """1.234,56"""
    return F.translate(F.format_number(value, decimals), ",.", ".,")


def english(value: Column, decimals: int = 2) -> Column:
    """1,234.56"""
    return F.format_number(value, decimals)


def report_text(spark: SparkSession, sf: str) -> Table:
    """lineitem as a report export: all text, several locales, some missing tokens, some unreadable cells.

    Every column's unreadable and missing cells follow from the keys, so the original table is the oracle.
    """
    li = table(spark, sf, "lineitem")
    price, qty, ship = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_shipdate")
    odd, gap = F.col("l_orderkey") % 97 == 0, F.col("l_partkey") % 31 == 0
    cents = F.date_format(ship, "dd.MM.yyyy")
    df = li.df.select(
        F.when(gap, "k.A.").when(odd, "unbekannt").otherwise(german(price)).alias("price_de"),
        F.when(gap, "n/a").otherwise(english(price)).alias("price_en"),
        F.when(odd, F.concat(F.lit("("), german(price), F.lit(")")))
        .otherwise(F.concat(german(price), F.lit(" "))).alias("booked"),
        F.concat(german(F.col("l_discount") * 100, 0), F.lit(" %")).alias("discount"),
        F.when(gap, F.lit(" - ")).otherwise(cents).alias("shipped_de"),
        F.date_format(ship, "MM/dd/yyyy").alias("shipped_us"),
        F.date_format(ship, "dd.MM.yy").alias("shipped_short"),
        F.date_format(ship, "yyyy-MM-dd'T'HH:mm:ss'+02:00'").alias("shipped_at"),
        F.concat(F.floor(qty).cast("string"), F.lit(":30")).alias("worked"),
        F.when(F.col("l_returnflag") == "R", "ja").otherwise("Nein").alias("returned"),
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("article"),
        F.col("l_linenumber").cast("string").alias("line"),
        F.when(qty > 25, "groß").otherwise("klein").alias("size"),
        F.col("l_orderkey").cast("string").alias("order_no"),
        *[F.col(k.name) for k in li.order],
    )
    return Table.of(df).with_df(df, order=li.order)


def boxed_prices(spark: SparkSession, sf: str) -> Table:
    """report_text's German price converted, its unreadable cells boxed, beside the order number."""
    from tallysheaf.operators.columns import select_columns
    from tallysheaf.plans.convert import convert
    from tallysheaf.plans.detect import detect_types

    picked = select_columns(report_text(spark, sf), [
        {"from": "order_no"}, {"from": "line"}, {"from": "price_de"}, {"from": "size"}])
    typing = detect_types(picked).choose("order_no", "text").choose("line", "text")
    return convert(picked, typing.confirm())


def exports(rows: DataFrame, head: str, path: str) -> str:
    """Write lines (``value``) as text files that each open with the header line, as report exports do."""
    placed = rows.select("value", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    heads = placed.select("p").distinct().select(F.lit(head).alias("value"), "p", F.lit(-1).cast("bigint").alias("i"))
    parts = placed.unionByName(heads).repartition("p").sortWithinPartitions("p", "i")
    parts.select("value", "p").write.partitionBy("p").text(path)
    return path


def frame(t: Table) -> DataFrame:
    return t.frame(companions=True)
