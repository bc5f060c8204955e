"""The lines of text files as tasks see them: in order within each split, whatever ends a line, in one of four encodings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.session import ship
from . import encoding as E

_UTF8_MARK = b"\xef\xbb\xbf"
#: How a line feed is stored, as text that Spark writes in UTF-8.
_FEED = {E.UTF16LE: "\n\x00", E.UTF16BE: "\x00\n"}


def _read(spark: SparkSession, path: str | list[str], feed: str) -> DataFrame:
    return spark.read.option("lineSep", feed).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def segments(spark: SparkSession, path: str | list[str], encoding: str = E.UTF8) -> DataFrame:
    """``file``, ``block`` (where a split starts), ``value``: what stands between line feeds, as bytes, in order within
    each split. UTF-16 arrives as UTF-8."""
    if encoding in _FEED:
        return _utf16_segments(spark, path, encoding)
    return _read(spark, path, "\n")


def _utf16_segments(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """Cut at the two bytes of a line feed, where they stand at an even offset: elsewhere they are halves of two characters.

    Offsets are the sums of what the splits before hold, one row a split, so tasks know whether theirs starts on an even
    one. A file of which a split starts within a character after all (two such halves right behind its border) is
    decoded whole by one task.
    """
    ship(spark)
    raw = _read(spark, path, _FEED[encoding])
    spans = raw.groupBy("file", "block").agg(F.sum(F.octet_length("value") + 2).alias("span"))
    before = F.sum("span").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    odd = spans.withColumn("base", F.coalesce(before, F.lit(0))).where("base % 2 = 1")
    # As a rule there is none.
    whole = [r["file"] for r in odd.select("file").distinct().collect()]
    feed, codec = _FEED[encoding].encode(), encoding

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, skip = None, [], False
        out: list[tuple] = []

        def close() -> None:
            if held:
                text = b"".join(held).decode(codec, "replace")
                out.append((*key, text.encode()))
                held.clear()

        for batch in batches:
            for file, block, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (file, block) != key:
                    close()
                    key, skip = (file, block), file in whole
                    if block == 0 and value[:2] in (b"\xff\xfe", b"\xfe\xff"):
                        value = value[2:]
                if skip:
                    continue
                held.append(value)
                if len(value) % 2:  # the feed is no feed: it starts at an odd offset
                    if sum(map(len, held)) % 2 or len(held) == 1:
                        held.append(feed)
                        continue
                if sum(map(len, held)) % 2 == 0:
                    close()
                else:
                    held.append(feed)
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["file", "block", "value"])
            out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["file", "block", "value"])

    split = raw.mapInArrow(cut, "file string, block long, value binary")
    if not whole:
        return split
    text = F.regexp_replace(F.decode("content", encoding.upper()), "\\A\ufeff", "")
    decoded = spark.read.format("binaryFile").load(whole).select(
        F.col("path").alias("file"), F.lit(0).cast("bigint").alias("block"), F.explode(F.split(F.regexp_replace(text, "\n\\z", ""), "\n")).alias("value"))
    return split.unionByName(decoded.withColumn("value", F.col("value").cast("binary")))


def lines_of(value: bytes, first: bool) -> list[bytes]:
    """A segment's lines: carriage returns end lines too, alone or before the line feed. The first of a file may start with
    a mark, which is no part of it."""
    if first and value.startswith(_UTF8_MARK):
        value = value[3:]
    if b"\r" not in value:
        return [value]
    return value.removesuffix(b"\r").split(b"\r")


def by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes, list[bytes]]]:
    """((file, block), head, lines): the lines of a batch's rows of one split, and the first bytes of a file where they
    start one. A split comes in as many pieces as it takes batches."""
    seen = None
    for batch in batches:
        lines, key, head = [], None, b""
        for file, block, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (file, block) != key:
                if key is not None:
                    yield key, head, lines
                lines, key, head = [], (file, block), b""
                if key != seen and block == 0:
                    head = value[:3]
                    lines = lines_of(value, True)
                    seen = key
                    continue
                seen = key
            lines += lines_of(value, False)
        if key is not None:
            yield key, head, lines
