"""Delimited text in: every cell stays text, every damaged record is set aside with its file line, nothing is padded.

Files are read twice, split by split. The first pass writes an index, one row a split: how many lines, what its bytes
say of the encoding, the first lines of it, and for each delimiter whether it ends inside a quoted field, for either way
that it may begin. From the index alone come encoding, delimiter, line numbers and every split's own beginning. The
second pass then reads each split from there and writes its records. No file has to pass through one task as a whole,
and no line is moved; only a record that reaches over a border between splits is put together from its pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import report as R
from ..naming import unique_columns
from ..plans.session import ship
from ..plans.storage import stored
from ..table import ORDER_PREFIX, TEXT, Col, OrderKey, Table, col
from . import encoding as E
from .lines import by_split, segments

# The delimiters tried, in this order, and how many records the guess looks at.
DELIMITERS = (",", ";", "\t", "|")
GUESS_RECORDS = 50
#: Lines read for each of them at most, on average.
GUESS_LINES = 8

_HEAD = GUESS_RECORDS * GUESS_LINES
_INDEX = ("file string, block long, lines long, filled long, shown long, valid boolean, nuls long, mark binary, head array<binary>, "
          "states array<struct<leave: array<boolean>, start: array<long>>>")


def _quoted(delimiter: str) -> str:
    """A complete quoted field at the start of a line or behind a delimiter."""
    d = "\\t" if delimiter == "\t" else f"\\{delimiter}"
    return rf'((?:\A|{d}))"[^"]*+(?:""[^"]*+)*+"(?={d}|\z)'


def _bare(text: Column, delimiter: str) -> Column:
    """The text with its quoted fields emptied: what is left of delimiters separates fields."""
    return F.when(text.contains('"'), F.regexp_replace(text, _quoted(delimiter), "$1")).otherwise(text)


def field_count(text: Column, delimiter: str) -> Column:
    bare = _bare(text, delimiter)
    return F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1


class Quotes:
    """What a line does to the state of being inside a quoted field, for one delimiter."""

    def __init__(self, delimiter: str):
        d = re.escape(delimiter)
        self.closed = re.compile(_quoted(delimiter).replace(r"\z", r"\Z").encode())
        self.open = re.compile(rf'(?:\A|{d})"(?![^"]*+(?:""[^"]*+)*+"(?!"))'.encode())

    def after(self, line: bytes, inside: bool) -> bool:
        """The state behind a line that was entered in a state. From inside it reads as if it began with a quote."""
        if b'"' not in line:
            return inside
        return self.open.search(self.closed.sub(rb"\1", b'"' + line if inside else line)) is not None


def split_index(spark: SparkSession, path: str | list[str], encoding: str = E.UTF8, delimiters: tuple[str, ...] = DELIMITERS) -> DataFrame:
    """One row per split, written once: ``file``, ``block``, its ``lines``, how many are not empty (``filled``) and not blank
    (``shown``), whether all are ``valid`` UTF-8, ``nuls``, a file's first bytes (``mark``), the ``head`` of the split, and by
    delimiter the state it leaves and the line its last record starts on, entered outside and inside a quoted field."""
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes = [Quotes(d) for d in delimiters]
        row = None

        def out() -> pa.RecordBatch:
            row["states"] = [{"leave": [bool(a), bool(b)], "start": [x or None, y or None]} for (a, b), (x, y) in zip(row.pop("state"), row.pop("start"), strict=True)]
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for (file, block), mark, lines in by_split(batches):
            if row is None or (row["file"], row["block"]) != (file, block):
                if row is not None:
                    yield out()
                row = {"file": file, "block": block, "lines": 0, "filled": 0, "shown": 0, "valid": True, "nuls": 0, "mark": mark, "head": [],
                       "state": [[False, True] for _ in quotes], "start": [[0, 0] for _ in quotes]}
            body = b"\n".join(lines)
            row["nuls"] += body.count(b"\0")
            try:
                body.decode()
            except UnicodeDecodeError:
                row["valid"] = False
            filled = [x for x in lines if x]
            row["head"] += filled[: _HEAD - len(row["head"])]
            row["filled"] += len(filled)
            row["shown"] += sum(1 for x in filled if x.strip(b" "))
            at, n = row["lines"], len(lines)
            marked = [i for i, x in enumerate(lines) if b'"' in x] if b'"' in body else []
            for q, state, start in zip(quotes, row["state"], row["start"], strict=True):
                done = 0
                for i in [*marked, n]:
                    for e in (0, 1):
                        # Lines without quotes leave the state; outside, each of them starts a record.
                        if not state[e] and (i > done or i < n):
                            start[e] = at + min(i + 1, n)
                    if i < n:
                        same = state[0] == state[1]
                        state[0] = q.after(lines[i], state[0])
                        state[1] = state[0] if same else q.after(lines[i], state[1])
                    done = i + 1
            row["lines"] += n
        if row is not None:
            yield out()

    schema = pa.schema([
        ("file", pa.string()), ("block", pa.int64()), ("lines", pa.int64()), ("filled", pa.int64()), ("shown", pa.int64()), ("valid", pa.bool_()),
        ("nuls", pa.int64()), ("mark", pa.binary()), ("head", pa.list_(pa.binary())),
        ("states", pa.list_(pa.struct([("leave", pa.list_(pa.bool_())), ("start", pa.list_(pa.int64()))])))])
    return stored(segments(spark, path, encoding).mapInArrow(read, _INDEX), "csv-index")


def _encodings(index: DataFrame) -> DataFrame:
    """Per file: ``encoding`` and ``nuls``, from the index; a mark decides, else valid UTF-8, else windows-1252."""
    files = index.groupBy("file").agg(
        F.bool_and("valid").alias("valid"), F.sum("nuls").alias("nuls"), F.max(F.hex("mark")).alias("head"))
    return files.select("file", "nuls", E.decided(F.col("head"), F.col("valid")).alias("encoding"))


def raw_lines(spark: SparkSession, path: str | list[str], encoding: str = E.UTF8) -> DataFrame:
    """``file``, ``block``, ``text`` - the lines, decoded; splits stay splits."""
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), _, lines in by_split(batches):
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(lines), pa.string()), pa.array([block] * len(lines), pa.int64()), pa.array(lines, pa.binary())], names=["file", "block", "text"])

    found = segments(spark, path, encoding).mapInArrow(read, "file string, block long, text binary")
    return found.select("file", "block", E.decoded(F.col("text").cast("string"), encoding).alias("text"))


def propose_delimiters(spark: SparkSession, path: str | list[str], encoding: str = E.UTF8) -> DataFrame:
    """One row per file: ``file``, ``delimiter`` (NULL where no candidate fits), from its first 50 non-empty records."""
    return _delimiters(split_index(spark, path, encoding))


def _delimiters(index: DataFrame) -> DataFrame:
    """Each candidate is judged by how little the field count moves from record to record, then by the wider rows; a
    candidate whose median row has fewer than two fields is out. Only splits that hold a file's first lines are asked."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    early = index.withColumn("before", F.coalesce(F.sum(F.size("head")).over(before), F.lit(0))).where(F.col("before") < _HEAD)
    first = early.select("file", "before", F.posexplode("head").alias("nth", "text")).select(
        "file", (F.col("before") + F.col("nth") + 1).alias("at"), F.col("text").cast("string").alias("text")).where(F.col("at") <= _HEAD)
    # Records, not lines: after an odd number of quotes a line goes on with the record before it, whatever parts fields.
    head = Window.partitionBy("file").orderBy("at")
    quotes = F.char_length("text") - F.char_length(F.replace("text", F.lit('"'), F.lit("")))
    open_ = F.coalesce(F.sum("quotes").over(head.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = first.withColumn("quotes", quotes).withColumn("begins", (open_ % 2 == 0).cast("int"))
    begun = begun.withColumn("record", F.sum("begins").over(head.rowsBetween(Window.unboundedPreceding, 0)))
    stitched = begun.groupBy("file", "record").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("lines"), F.sum("quotes").alias("quotes"))
    # A quote that is never closed gathers nothing: its lines are judged one by one.
    texts = F.when(F.col("quotes") % 2 == 0, F.array(F.array_join("lines", "\n"))).otherwise(F.col("lines"))
    first = stitched.select("file", "record", F.posexplode(texts).alias("nth", "text")).withColumn(
        "at", F.row_number().over(Window.partitionBy("file").orderBy("record", "nth"))).where(F.col("at") <= GUESS_RECORDS)
    counts = first.select("file", "at", F.explode(F.array(*[
        F.struct(F.lit(i).alias("candidate"), field_count(F.col("text"), d).alias("fields"))
        for i, d in enumerate(DELIMITERS)
    ])).alias("x")).select("file", "at", "x.*")
    step = Window.partitionBy("file", "candidate").orderBy("at")
    judged = counts.withColumn(
        "move", F.coalesce(F.abs(F.col("fields") - F.lag("fields").over(step)), F.lit(0))
    ).groupBy("file", "candidate").agg(
        F.sum("move").alias("moves"), F.expr("percentile(fields, 0.5)").alias("median"))
    fit = F.struct(F.col("moves"), -F.col("median"), F.col("candidate"))
    best = judged.groupBy("file").agg(F.min_by("candidate", F.when(F.col("median") >= 2, fit)).alias("best"))
    return best.select(
        "file", F.get(F.array(*map(F.lit, DELIMITERS)), F.col("best")).alias("delimiter"))


def _beginnings(index: DataFrame, candidate: int) -> DataFrame:
    """How each split begins: ``file``, ``block``, ``enter`` (inside a quoted field), ``offset`` (lines before it), ``start`` (the
    line that the record open there starts on) and ``unclosed`` (the line from which on a quote of the file never closes).

    A split maps the state before it to the one behind it. Most settle it whatever came before, the others keep or flip
    it: so a state is the last settled one, flipped as often as splits since then flip.
    """
    state = index.select("file", "block", "lines", F.col("states")[candidate].alias("s"))
    state = state.select("file", "block", "lines", F.col("s.leave")[0].alias("from_out"), F.col("s.leave")[1].alias("from_in"),
                         F.col("s.start")[0].alias("start_out"), F.col("s.start")[1].alias("start_in"))
    splits = Window.partitionBy("file").orderBy("block")
    before = splits.rowsBetween(Window.unboundedPreceding, -1)
    turns = state.withColumn("settles", F.when(F.col("from_out") == F.col("from_in"), F.col("from_out"))).withColumn(
        "flips", (F.col("from_out") & ~F.col("from_in")).cast("int"))
    turns = turns.withColumn("all", F.sum("flips").over(splits)).withColumn(
        "mark", F.when(F.col("settles").isNotNull(), F.struct("settles", "all")))
    turns = turns.withColumn("last", F.last("mark", ignorenulls=True).over(before)).withColumn("past", F.coalesce(F.sum("flips").over(before), F.lit(0)))
    odd = (F.coalesce(F.col("last.settles"), F.lit(False)).cast("int") + F.col("past") - F.coalesce(F.col("last.all"), F.lit(0))) % 2 == 1
    begun = turns.withColumn("enter", odd).withColumn("offset", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    begun = begun.withColumn("leave", F.when(F.col("enter"), F.col("from_in")).otherwise(F.col("from_out"))).withColumn(
        "own", F.when(F.col("enter"), F.col("start_in")).otherwise(F.col("start_out")) + F.col("offset"))
    whole = Window.partitionBy("file")
    end = F.last("leave").over(splits.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return begun.select("file", "block", "enter", "offset", F.max("own").over(before).alias("start"),
                        F.when(end, F.max("own").over(whole)).alias("unclosed"))


def records(
    spark: SparkSession, path: str | list[str], delimiter: str, encoding: str = E.UTF8
) -> DataFrame:
    """``file``, ``line``, ``text``, ``fields``, ``malformed``, ``unclosed``: the records, numbered by the file line they start on.

    A line belongs to the record that was open when it began. A quote that is never closed would swallow the rest of its
    file; its lines are handed out one by one, flagged, instead of being gathered into one cell. A record is ``malformed``
    if a field opens with a quote and goes on after closing it. The records are written once, as a table.
    """
    wanted = DELIMITERS if delimiter in DELIMITERS else (*DELIMITERS, delimiter)
    return _records(spark, path, split_index(spark, path, encoding, wanted), delimiter, encoding)


def _records(spark: SparkSession, path: str | list[str], index: DataFrame, delimiter: str, encoding: str) -> DataFrame:
    candidate = DELIMITERS.index(delimiter) if delimiter in DELIMITERS else len(DELIMITERS)
    # A few numbers a split: less than the list of splits that Spark's own driver keeps.
    known: dict[str, list] = {}
    for r in _beginnings(index, candidate).collect():
        known.setdefault(r["file"], []).append((r["block"], int(r["enter"]), r["offset"], r["start"] or 0, r["unclosed"] or 0))
    sent = spark.sparkContext.broadcast({f: np.array(sorted(rows), np.int64) for f, rows in known.items()})
    schema = pa.schema([("file", pa.string()), ("line", pa.int64()), ("text", pa.binary()), ("unclosed", pa.bool_()), ("start", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes = Quotes(delimiter)
        key, inside, line, from_, start, torn = None, False, 0, 0, 0, False
        held: list[bytes] = []
        out: list[tuple] = []

        def close() -> None:
            if held:
                out.append((key[0], line - len(held) + 1, b"\n".join(held), False, start if torn else None))
                held.clear()

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for place, _, lines in by_split(batches):
            if place != key:
                torn = True  # what is still open goes on in the next split
                close()
                key = place
                rows = sent.value.get(key[0], np.zeros((0, 5), np.int64))
                mine = rows[rows[:, 0] == key[1]]
                if len(mine) == 0:
                    raise RuntimeError(f"{key[0]} was split otherwise when its index was made")
                _, inside, line, start, from_ = (int(x) for x in mine[0])
                inside = torn = bool(inside)
            for text in lines:
                line += 1
                if from_ and line >= from_:
                    out.append((key[0], line, text, True, None))
                    continue
                if not inside:
                    start, torn = line, False
                held.append(text)
                inside = quotes.after(text, inside)
                if not inside:
                    close()
            yield batch_of()
        torn = True
        close()
        if out:
            yield batch_of()

    d = "\\t" if delimiter == "\t" else f"\\{delimiter}"
    text = F.col("text")
    malformed = ~F.col("unclosed") & text.contains('"') & _bare(text, delimiter).rlike(rf'(?:\A|{d})"')
    told = [field_count(text, delimiter).alias("fields"), malformed.alias("malformed")]
    found = segments(spark, path, encoding).mapInArrow(read, "file string, line long, text binary, unclosed boolean, start long")
    found = found.withColumn("text", E.decoded(text.cast("string"), encoding if encoding == E.CP1252 else E.UTF8))
    table = stored(found.select("file", "line", "text", "unclosed", "start", *told), "csv-records")
    whole = table.where("start IS NULL").select("file", "line", "text", "fields", "malformed", "unclosed")
    pieces = table.where("start IS NOT NULL").groupBy("file", F.col("start").alias("line")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text")).withColumn("unclosed", F.lit(False))
    return whole.unionByName(pieces.select("file", "line", "text", "unclosed", *told))


def propose_header_rows(found: DataFrame) -> DataFrame:
    """One row per file: ``file``, ``header_line``, ``fields`` - the first record of the most frequent width."""
    widths = found.groupBy("file", "fields").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))
    best = F.struct("n", "fields")
    return widths.groupBy("file").agg(
        F.max_by("line", best).alias("header_line"), F.max_by("fields", best).alias("fields"))


def _cells(text: Column, delimiter: str, width: int) -> Column:
    """The cells of a record as an array of text. Only a record with quotes needs the CSV parser."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    parsed = F.from_csv(
        text, schema, {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE",
                       "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
                       "maxCharsPerColumn": "-1", "lineSep": "\u0001"})
    quoted = F.array(*[F.coalesce(parsed[f"c{i}"], F.lit("")) for i in range(width)])
    split = F.split(text, "\\t" if delimiter == "\t" else f"\\{delimiter}", -1)
    return F.when(text.contains('"'), quoted).otherwise(split)


@dataclass(frozen=True)
class CsvSource:
    """Read text: the table of good records, the records set aside, and what was noticed."""

    table: Table
    #: ``file``, ``row`` (file line), ``fields``, ``raw``, ``reason`` (field_count or unclosed_quote)
    quarantine: DataFrame
    #: The same columns of records that are read although a field goes on after its closing quote (malformed_quote).
    malformed: DataFrame
    delimiter: str
    header_row: int
    encoding: str
    diagnostics: tuple[R.Diagnostic, ...]


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    delimiter: str | None = None,
    header_row: int | None = None,
    encoding: str | None = None,
    max_rows_named: int = 100,
) -> CsvSource:
    """Delimited files as one all-text table. What is not given is proposed from the files; files must agree on it.

    ``max_rows_named`` bounds the row numbers listed inside a diagnostic; the quarantine frame, and that of malformed
    quotes, hold all of them.
    """
    found: list[R.Diagnostic] = []
    wanted = DELIMITERS if delimiter is None or delimiter in DELIMITERS else (*DELIMITERS, delimiter)
    index = split_index(spark, path, encoding or E.UTF8, wanted)
    if encoding is None:
        kinds = _encodings(index).groupBy("encoding").agg(F.sum("nuls").alias("count"), F.count(F.lit(1)).alias("files")).collect()
        if len(kinds) > 1:
            raise R.Refused([R.error("csv.mixed_encodings", values=sorted(k["encoding"] for k in kinds))])
        encoding = kinds[0]["encoding"] if kinds else E.UTF8
        if encoding in (E.UTF16LE, E.UTF16BE):
            # Lines end otherwise there.
            index = split_index(spark, path, encoding, wanted)
        elif kinds and kinds[0]["count"]:
            found.append(R.unresolved("encoding.nul_bytes", count=kinds[0]["count"], files=kinds[0]["files"]))
    E._check(encoding)

    if not index.agg(F.coalesce(F.sum("shown"), F.lit(0)).alias("n")).first()["n"]:
        empty = Table.of(spark.createDataFrame([], "`__none` string").drop("__none"))
        none = spark.createDataFrame([], "file string, row bigint, fields int, raw string, reason string")
        return CsvSource(empty, none, none, delimiter or ",", 1, encoding, (*found, R.warning("csv.empty")))
    if delimiter is None:
        delimiter = _agreed(_delimiters(index), "delimiter", "csv.mixed_delimiters")
        if delimiter is None:
            delimiter = ","
            found.append(R.unresolved("csv.delimiter_undetectable", fallback=","))

    recs = _records(spark, path, index, delimiter, encoding)
    headers = propose_header_rows(recs)
    if header_row is not None:
        # The record that holds the line, or the first one.
        held = F.max(F.when(F.col("line") <= int(header_row), F.col("line")))
        headers = recs.groupBy("file").agg(F.coalesce(held, F.min("line")).alias("header_line"))
    header = recs.join(headers.select("file", "header_line"), "file").where(F.col("line") == F.col("header_line"))
    # One row per distinct header, not per file.
    texts = header.groupBy("text", "fields").agg(
        F.min("header_line").alias("line"), F.count(F.lit(1)).alias("files")).orderBy(F.desc("files")).limit(2).collect()
    if len(texts) > 1:
        raise R.Refused([R.error("csv.headers_differ", first=texts[0]["text"], other=texts[1]["text"])])
    width, line = texts[0]["fields"], texts[0]["line"]
    name_row = spark.range(1).select(_cells(F.lit(texts[0]["text"]), delimiter, width).alias("n")).first()["n"]
    names, renamed = unique_columns(name_row)
    if renamed:
        found.append(R.warning("source.columns_renamed", renamed=renamed))

    # A header line whose quote never closes names the columns and is set aside too, with its text.
    body = recs.join(headers.select("file", "header_line"), "file").where(
        (F.col("line") > F.col("header_line")) | (F.col("unclosed") & (F.col("line") == F.col("header_line"))))
    good = ~F.col("unclosed") & (F.col("fields") == width)
    # A line break at the very end of a file makes no record; blank lines elsewhere are records of one empty field.
    keys = (OrderKey(f"{ORDER_PREFIX}0"), OrderKey(f"{ORDER_PREFIX}1"))
    cells = body.where(good).select(
        _cells(F.col("text"), delimiter, width).alias("cells"),
        F.col("file").alias(keys[0].name), F.col("line").alias(keys[1].name))
    df = cells.select(
        *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)], *[col(k.name) for k in keys])
    table = Table(df, tuple(Col(n, TEXT) for n in names), keys)

    def aside(which: Column, reason: Column) -> DataFrame:
        return body.where(which).select("file", F.col("line").alias("row"), "fields", F.col("text").alias("raw"), reason.alias("reason"))

    quarantine = aside(~good, F.when(F.col("unclosed"), "unclosed_quote").otherwise("field_count"))
    malformed = aside(F.col("malformed"), F.lit("malformed_quote"))
    found += csv_damage(body, width, max_rows_named)
    return CsvSource(table, quarantine, malformed, delimiter, line, encoding, tuple(found))


def _agreed(per_file: DataFrame, column: str, code: str) -> str | None:
    """The one value all files share; files that disagree cannot be one source."""
    values = [r[0] for r in per_file.select(column).distinct().limit(3).collect()]
    if len(values) > 1:
        raise R.Refused([R.error(code, values=sorted(str(v) for v in values))])
    return values[0] if values else None


def csv_damage(body: DataFrame, expected: int, max_rows_named: int = 100) -> list[R.Diagnostic]:
    """What is wrong with the records: one count over the written records' flags, and their first row numbers where there
    are any."""
    unclosed = F.col("unclosed")
    wrong = {"field_count": ~unclosed & (F.col("fields") != expected), "malformed": F.col("malformed")}
    seen = body.agg(
        F.min(F.when(unclosed, F.col("line"))).alias("unclosed"),
        *[R.count_if(c).alias(n) for n, c in wrong.items()]).first()

    def rows(name):
        first = body.where(wrong[name]).orderBy("file", "line").limit(max_rows_named)
        return [r["line"] for r in first.select("line").collect()]

    out = []
    if seen["unclosed"] is not None:
        out.append(R.error("csv.unclosed_quote", row=seen["unclosed"]))
    if seen["malformed"]:
        out.append(R.warning("csv.malformed_quote", count=seen["malformed"], rows=rows("malformed")))
    if seen["field_count"]:
        out.append(R.warning(
            "csv.field_count_mismatch", expected=expected, count=seen["field_count"], rows=rows("field_count")))
    return out
