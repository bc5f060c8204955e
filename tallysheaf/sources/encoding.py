"""Which of four encodings a text file is in: a byte-order mark decides, else valid UTF-8, else windows-1252."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import report as R

UTF8, CP1252, UTF16LE, UTF16BE = ENCODINGS = ("utf-8", "windows-1252", "utf-16le", "utf-16be")

# The byte-order marks, longest first.
BOMS = {UTF8: "EFBBBF", UTF16LE: "FFFE", UTF16BE: "FEFF"}

# What windows-1252 means by bytes 0x80-0x9F; five of them it leaves to the control characters.
_CP1252_FROM = "".join(map(chr, (
    0x80, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x8B, 0x8C, 0x8E,
    0x91, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0x9B, 0x9C, 0x9E, 0x9F)))
_CP1252_TO = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def decoded(line: Column, encoding: str) -> Column:
    """The text of a raw line (as the text source delivers it) under an encoding whose line breaks are bytes."""
    if encoding == UTF8:
        return line
    if encoding == CP1252:
        return F.translate(F.decode(line.cast("binary"), "ISO-8859-1"), _CP1252_FROM, _CP1252_TO)
    raise ValueError(f"{encoding} is decoded by its reader, not line by line")


def _check(encoding: str) -> None:
    if encoding not in ENCODINGS:
        raise ValueError(f"unknown encoding: {encoding}")


def _marked(head: Column) -> Column:
    """The encoding that a file's first bytes, in hex, are the mark of."""
    mark = None
    for encoding, bom in BOMS.items():
        mark = F.when(head.startswith(bom), encoding) if mark is None else mark.when(head.startswith(bom), encoding)
    return mark


def decided(head: Column, valid: Column) -> Column:
    """A mark decides, else valid UTF-8, else windows-1252."""
    return F.coalesce(_marked(head), F.when(valid, UTF8).otherwise(CP1252))


def detect_encodings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file: ``file``, ``encoding``, ``decided_by`` (bom, probe or fallback), ``nul_bytes``.

    Validity is a property of all lines and folds into one flag per file; the mark is the head of the first line.
    The lines are split on bytes, so a multi-byte character never straddles two of them.
    """
    # Only '\n' as separator: the default reader would swallow a UTF-8 mark before it can be seen.
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        F.col("value"),
    )
    head = F.hex(F.substring(F.col("value").cast("binary"), 1, 3))
    per_file = lines.select(
        "file", "block", "id", F.is_valid_utf8("value").alias("valid"), head.alias("head"), _nuls().alias("nuls")
    ).groupBy("file").agg(
        F.bool_and("valid").alias("valid"), F.sum("nuls").alias("nul_bytes"),
        F.min_by("head", F.struct("block", "id")).alias("head"),
    )
    mark = _marked(F.col("head"))
    return per_file.select(
        "file",
        decided(F.col("head"), F.col("valid")).alias("encoding"),
        F.when(mark.isNotNull(), "bom").when(F.col("valid"), "probe").otherwise("fallback").alias("decided_by"),
        "nul_bytes",
    )


def _nuls() -> Column:
    value = F.col("value")
    return F.length(value) - F.length(F.replace(value, F.lit("\u0000"), F.lit("")))


def nul_bytes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """U+0000 per file: the trace BOM-less UTF-16 leaves in text that passes for UTF-8."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), "value").groupBy("file").agg(F.sum(_nuls()).alias("nul_bytes"))


def nul_diagnostics(counts: DataFrame) -> list[R.Diagnostic]:
    found = counts.where(F.col("nul_bytes") > 0).agg(
        F.sum("nul_bytes").alias("count"), F.count(F.lit(1)).alias("files")).first()
    if not found["files"]:
        return []
    return [R.unresolved("encoding.nul_bytes", count=found["count"], files=found["files"])]
