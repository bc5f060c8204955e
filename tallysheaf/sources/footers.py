"""What Parquet files say about their columns: every file's footer, read by the tasks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from ..plans.session import ship

SCHEMA = "file string, at int, name string, repeated int, physical string, logical string, type string, codecs array<string>, problem string"

# Unsigned types as the wider signed ones that hold them.
_UNSIGNED = {pa.uint8(): "smallint", pa.uint16(): "int", pa.uint32(): "bigint", pa.uint64(): "decimal(20,0)"}


def _leaves(kind: pa.DataType) -> int:
    return sum(_leaves(kind.field(i).type) for i in range(kind.num_fields)) if kind.num_fields else 1


def _type(field: pa.Field, physical: str, nanos: bool) -> str | None:
    """The Spark type a column is read as, None where there is none. Nanoseconds are read as the longs they are stored as."""
    if nanos:
        return "bigint"
    if physical == "INT96":
        return "timestamp"
    if field.type in _UNSIGNED:
        return _UNSIGNED[field.type]
    try:
        return from_arrow_type(field.type, prefer_timestamp_ntz=True).simpleString()
    except Exception:  # whatever a type can't be turned into is a column that can't be read, not a file
        return None


def _open(path: str):
    """A file that a task can open: any scheme that the file systems of pyarrow know."""
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem().open_input_file("/" + unquote(path[5:]).lstrip("/"))
    system, inner = pa.fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _columns(path: str) -> Iterator[tuple]:
    with _open(path) as file:
        footer = pq.read_metadata(file)
    schema, fields, leaf = footer.schema, footer.schema.to_arrow_schema(), 0
    names = Counter(f.name for f in fields)
    for at, field in enumerate(fields):
        mine = range(leaf, leaf + _leaves(field.type))
        leaf = mine.stop
        first = schema.column(mine.start)
        logical = first.logical_type
        nanos = len(mine) == 1 and logical.type == "TIMESTAMP" and "nanoseconds" in logical.to_json()
        codecs = {footer.row_group(g).column(i).compression for g in range(footer.num_row_groups) for i in mine}
        kind = "NANOS" if nanos else "NESTED" if field.type.num_fields else logical.type
        yield path, at, field.name, names[field.name], first.physical_type, kind, _type(field, first.physical_type, nanos), sorted(codecs), None


def footers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per column of every file: file, at (its place), name, repeated (columns of that name in the file), physical and
    logical type, Spark type (null if none), codecs, problem. A footer that a task can't read is one row with the problem.

    Files are listed by Spark without opening them; a task then reads the last bytes of some of them.
    """
    ship(spark)
    listed = spark.read.format("binaryFile").load(paths).select("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
        names = ["file", "at", "name", "repeated", "physical", "logical", "type", "codecs", "problem"]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    rows = list(_columns(path))
                except Exception as failure:  # a scheme only Spark can open, or no Parquet file: Spark's reader will tell
                    rows = [(path, *[None] * 7, f"{type(failure).__name__}: {failure}"[:300])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else
                                                 [pa.array([], k) for k in kinds], names=names)

    return listed.mapInArrow(read, SCHEMA)


def columns(spark: SparkSession, paths: list[str]) -> list:
    """The distinct columns over all files, in order: name, repeated, physical, logical, type, codecs, files, problem. As many
    rows as the files' schemas differ in columns, however many files there are."""
    found = footers(spark, paths).groupBy("name", "repeated", "physical", "logical", "type", "codecs", "problem").agg(
        F.min("at").alias("at"), F.count("*").alias("files"))
    return sorted(found.collect(), key=lambda r: (r["at"] is None, r["at"], r["name"] or ""))
