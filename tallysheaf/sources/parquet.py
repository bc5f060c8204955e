"""Parquet in: the file's schema is authoritative, so columns arrive typed and are only swept, never guessed."""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import report as R
from ..plans.detect import native_sweep
from ..table import NANOS_SUFFIX, ORDER_PREFIX, RAW_SUFFIX, OrderKey, Table, box_of, col, free_name, nanos_of
from .footers import columns

NESTED = (T.StructType, T.ArrayType, T.MapType, T.VariantType)
#: Codecs that Spark brings no library for.
UNSUPPORTED_CODECS = frozenset({"BROTLI", "LZO"})


def _open(spark: SparkSession, paths: list[str], schema: T.StructType | None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        return reader.parquet(*paths)
    except AnalysisException as failure:
        if failure.getCondition() != "UNSUPPORTED_TIME_TYPE":
            raise
        # A time of day is read only to be handed on as text, by a session of its own that can.
        own = spark.newSession()
        own.conf.set("spark.sql.timeType.enabled", "true")
        own.conf.set("spark.sql.session.timeZone", "UTC")
        return (own.read.schema(schema) if schema is not None else own.read).parquet(*paths)


def _from_footers(found: list, diagnostics: list[R.Diagnostic]) -> tuple[T.StructType | None, list[str]]:
    """The schema to read with where Spark's own would refuse the files, and the columns of nanoseconds.

    None of the columns that share a name is read, as a name is all that tells them apart; a column of a type that Spark
    has none for is left out as well. The other columns are.
    """
    codecs = sorted({c for r in found for c in r["codecs"] or ()} & UNSUPPORTED_CODECS)
    R.refuse_if([R.error("parquet.unsupported_codec", codec=c) for c in codecs])
    named = [r for r in found if r["problem"] is None]
    repeated = {r["name"]: r["repeated"] for r in named if r["repeated"] > 1}
    diagnostics += [R.warning("parquet.duplicate_column_name", column=n, columns=k) for n, k in repeated.items()]
    nanos = list(dict.fromkeys(r["name"] for r in named if r["logical"] == "NANOS" and r["name"] not in repeated))
    if not repeated and not nanos:
        return None, []
    kept = {r["name"]: r["type"] for r in reversed(named) if r["name"] not in repeated}
    diagnostics += [R.warning("parquet.unreadable_column", column=n) for n, kind in kept.items() if kind is None]
    fields = [T.StructField(n, T.StructType.fromDDL(f"c {kept[n]}")["c"].dataType) for n in dict.fromkeys(r["name"] for r in named) if kept.get(n)]
    return T.StructType(fields), nanos


def _cell(f: T.StructField, nanos: bool, found: list[R.Diagnostic]) -> Column:
    """A column as the kind of cell it is read as, and what there is to say of it."""
    cell = col(f.name)
    if nanos:
        # Whole microseconds, rounded down before the epoch too; what is left is the companion's.
        whole = F.floor((cell - F.pmod(cell, F.lit(1000))).cast("decimal(20,0)") / 1000).cast("bigint")
        return F.timestamp_micros(whole).cast("timestamp_ntz")
    if isinstance(f.dataType, NESTED):
        found.append(R.warning("parquet.nested_column", column=f.name))
        return F.to_json(cell)
    if isinstance(f.dataType, T.TimestampType):
        return cell.cast("timestamp_ntz")
    if isinstance(f.dataType, T.BinaryType):
        found.append(R.warning("parquet.unsupported_type", column=f.name, type="BYTE_ARRAY"))
        return cell.cast("string")
    if isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampNTZType)):
        return cell
    found.append(R.warning("parquet.unsupported_type", column=f.name, type=f.dataType.simpleString()))
    return cell.cast("string")


def read_parquet(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    sweep: bool = True,
) -> tuple[Table, list[R.Diagnostic]]:
    """A table over Parquet files, and what was noticed about their columns.

    Numbers of any width and decimals are numbers, kept in their own Spark type (a 64-bit integer stays exact).
    Nested columns become JSON text, binary columns text. Columns of nanoseconds become datetimes with the digits below
    the microsecond beside them. Of columns that share a name none is read, the others are. A codec that Spark can't
    read is refused. All of this comes from the files' footers, which tasks read in one small job; where a scheme is one
    that only Spark can open, Spark's own schema decides. ``schema`` narrows the read.

    Numbers that are not finite are unreadable: one scan of the float columns alone counts them, and a column that has
    some gets a box. ``sweep=False`` leaves that scan out where it is known that there are none.
    """
    paths = [path] if isinstance(path, str) else list(path)
    found: list[R.Diagnostic] = []
    given, nanos = _from_footers(columns(spark, paths), found)
    if schema is not None:
        given = T.StructType([T.StructField(f.name, T.LongType()) if f.name in nanos else f for f in schema.fields])
    df = _open(spark, paths, given)
    names = [f.name for f in df.schema.fields]
    taken, exprs, fine = set(names), [], {}
    for f in df.schema.fields:
        exprs.append(_cell(f, f.name in nanos, found).alias(f.name, metadata=f.metadata or {}))
        if f.name in nanos:
            fine[f.name] = free_name(f.name + NANOS_SUFFIX, taken)
            exprs.append(nanos_of(F.pmod(col(f.name), F.lit(1000)), f.name, fine[f.name]))
    # The position columns come straight off the scan and are pruned wherever no order is consumed.
    table = Table.of(df.select(*exprs))
    keys = (OrderKey(f"{ORDER_PREFIX}0"), OrderKey(f"{ORDER_PREFIX}1"))
    position = [F.col("_metadata.file_path").alias(keys[0].name), F.col("_metadata.row_index").alias(keys[1].name)]
    table = table.with_df(df.select(*exprs, *position), order=keys)
    floats = [f.name for f in table.df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and table.has(f.name)]
    counts = {r["column"]: r["unreadable"] for r in native_sweep(table, floats).collect()} if sweep and floats else {}
    boxed = {n: count for n, count in counts.items() if count}
    return (_boxed(table, list(boxed)), [*found, *[R.warning("parquet.non_finite_number", column=n, count=c) for n, c in boxed.items()]])


def _boxed(table: Table, names: list[str]) -> Table:
    """The table with the numbers of these columns that are not finite moved into boxes, spelled out."""
    if not names:
        return table
    cells, taken, raws = [], set(table.df.columns), {}
    for name in table.df.columns:
        cell = col(name)
        if name in names:
            bad = F.isnan(cell) | (F.abs(cell) == float("inf"))
            cells.append(F.when(~bad, cell).alias(name))
            spelled = F.when(F.isnan(cell), "NaN").when(cell > 0, "Infinity").otherwise("-Infinity")
            raws[name] = free_name(name + RAW_SUFFIX, taken)
            cells.append(box_of(F.when(bad, spelled), name, raws[name]))
        else:
            cells.append(cell)
    cols = tuple(replace(c, raw=raws[c.name]) if c.name in raws else c for c in table.cols)
    return table.with_df(table.df.select(*cells), cols=cols)
