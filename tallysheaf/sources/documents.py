"""JSON documents read in splits: one value over many lines, taken apart into the elements of its outermost array.

A string in JSON holds no line break, so every line starts outside of strings, and all that a split must know of those
before it is how deep in brackets it begins. Each split sums up its own brackets; the sums add up to that depth. Splits
then hand out the elements that they hold whole, the pieces of those that reach over a border, and what stands between
elements as one mark each, by which a file is found to be an array of objects, one object, or neither.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.session import ship
from ..plans.storage import stored
from .lines import by_split, segments

#: A string, a bracket, a comma or a run of anything else that isn't white space; a quote that no string starts with is damage.
_TOKEN = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\],]|[^\s{}\[\],"]+|"')
#: What stands outside of elements, as marks: the array's brackets, commas, E for an object; O for one that is all there is.
#: X is anything else. Repeated elements are one.
_SHAPES = {"array": r"\A\[E(?:,E)*\]\z", "object": r"\AO\z"}
_REPEATED = re.compile(rb"(?:E,)+(?=E)")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _spans(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file``, ``block``, ``lines``, ``turn`` (how much deeper in brackets the split ends than it begins), ``first`` token."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("lines", pa.int64()), ("turn", pa.int64()), ("first", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list] = {}
        for key, _, lines in by_split(batches):
            row = seen.setdefault(key, [0, 0, None])
            row[0] += len(lines)
            for line in lines:
                tokens = _TOKEN.findall(line)
                row[1] += sum(t in b"{[" for t in tokens) - sum(t in b"}]" for t in tokens)
                row[2] = row[2] or (tokens[0] if tokens else None)
        yield _rows([(*k, *v) for k, v in seen.items()], schema)

    return segments(spark, paths).mapInArrow(read, "file string, block long, lines long, turn long, first binary")


def elements(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``file``, ``line``, ``column``, ``text``) of every outermost object, by where it starts; and (``file``, ``shape``): ``array`` of
    objects, one ``object``, or null, for which a file's elements mean nothing. Whether each object is sound isn't judged.

    Both come from a table that is written once. The files are read twice, each split of them by a task of its own.
    """
    ship(spark)
    spans = stored(_spans(spark, paths), "document-splits")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    begun = spans.select(
        "file", "block", F.coalesce(F.sum("turn").over(before), F.lit(0)).alias("depth"), F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("offset"),
        F.first("first", ignorenulls=True).over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("outer"))
    # A few numbers a split: less than the list of splits that Spark's own driver keeps.
    known: dict[str, list] = {}
    for r in begun.collect():
        known.setdefault(r["file"], []).append((r["block"], r["depth"], r["offset"], int(r["outer"] == b"[")))
    sent = spark.sparkContext.broadcast({f: np.array(sorted(rows), np.int64) for f, rows in known.items()})
    schema = pa.schema([("file", pa.string()), ("line", pa.int64()), ("column", pa.int64()), ("text", pa.binary()), ("kind", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, depth, line, base, opened, place = None, 0, 0, 0, False, (0, 0)
        held: list[bytes] = []
        out: list[tuple] = []
        marks: list[bytes] = []

        def close(ended: bool) -> None:
            if held:
                kind = ("whole" if ended else "open") if opened else "more"
                out.append((key[0], *place, b"\n".join(held), kind))
                held.clear()

        def leave() -> None:
            close(False)
            if key is not None:
                out.append((key[0], key[1], 0, _REPEATED.sub(b"", b"".join(marks)), "marks"))
                marks.clear()

        for split, _, lines in by_split(batches):
            if split != key:
                leave()
                key = split
                rows = sent.value[key[0]]
                _, depth, line, base = (int(x) for x in rows[rows[:, 0] == key[1]][0])
                opened, place = False, (line + 1, 0)
            for text in lines:
                line += 1
                begin = 0 if depth > base else None
                for found in _TOKEN.finditer(text):
                    token = found[0]
                    if depth == base and token == b"{":
                        opened, place, begin = True, (line, found.start()), found.start()
                        marks.append(b"E" if base else b"O")
                    elif depth <= base:
                        between = depth == 1 and token in (b",", b"]") or depth == 0 and base and token == b"["
                        marks.append(token if between else b"X")
                    depth += 1 if token in b"{[" else -1 if token in b"}]" else 0
                    if begin is not None and depth <= base:
                        held.append(text[begin : found.end()])
                        close(True)
                        begin = None
                if begin is not None:
                    held.append(text[begin:])
            if len(marks) > 10_000:
                marks[:] = [_REPEATED.sub(b"", b"".join(marks))]
            yield _rows(out, schema)
            out = []
        leave()
        yield _rows(out, schema)

    written = segments(spark, paths).mapInArrow(read, "file string, line long, column long, text binary, kind string")
    table = stored(written.withColumn("text", F.col("text").cast("string")), "document-elements")
    signs = table.where("kind = 'marks'").groupBy("file").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "").alias("marks"))
    shape = None
    for name, form in _SHAPES.items():
        shape = F.when(F.col("marks").rlike(form), name) if shape is None else shape.when(F.col("marks").rlike(form), name)
    # An element over a border: its opening piece, and those of the splits after it; two pieces a split at most.
    pieces = table.where("kind IN ('open', 'more')").withColumn("of", F.sum((F.col("kind") == "open").cast("int")).over(W.partitionBy("file").orderBy("line", "column")))
    joined = pieces.groupBy("file", "of").agg(F.array_sort(F.collect_list(F.struct("line", "column", "text"))).alias("parts")).select(
        "file", F.col("parts")[0]["line"].alias("line"), F.col("parts")[0]["column"].alias("column"),
        F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text"))
    whole = table.where("kind = 'whole'").select("file", "line", "column", "text")
    return whole.unionByName(joined), signs.select("file", shape.alias("shape"))
