"""Folders of workbooks in: each file is opened by one task into long cell rows; everything after that is Spark's.

A workbook is a zip of XML parts and a single-task unit by its format. The task emits its cells as it reads them;
which row is the header, what kind a column is and the pivot to columns are grouped and joined across all files.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import report as R
from ..functions.text import is_missing, trimmed
from ..naming import unique_columns
from ..plans.storage import stored
from ..table import BOOLEAN, DATE, DATETIME, NUMBER, ORDER_PREFIX, TEXT, Col, OrderKey, Table, box_of, col, free_name

CELL_SCHEMA = "file string, sheet_index int, sheet string, row int, col int, kind string, text string, problem string"

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATE_LETTERS = re.compile(r"[ymdhs]", re.I)
_NOT_FORMAT = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]|_.')
_EPOCH = datetime.datetime(1899, 12, 30)
_EPOCH_1904 = datetime.datetime(1904, 1, 1)


def _is_date_format(number: int, code: str | None) -> bool:
    if code is None:
        return 14 <= number <= 22 or 27 <= number <= 36 or 45 <= number <= 47 or 50 <= number <= 58
    return bool(_DATE_LETTERS.search(_NOT_FORMAT.sub("", code)))


def _column_index(reference: str) -> int:
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n


def _number_text(value: float) -> str:
    return str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)


def _cell(kind: str, value: str | None, is_date: bool, shared: list[str], epoch) -> tuple[str, str] | None:
    """(kind, canonical text) of one cell; None for an empty one."""
    if value is None or value == "":
        return None
    if kind == "s":
        return TEXT, shared[int(value)]
    if kind in ("str", "inlineStr", "e"):
        return TEXT, value
    if kind == "b":
        return BOOLEAN, "true" if value == "1" else "false"
    if kind == "d":
        at = datetime.datetime.fromisoformat(value.replace("Z", ""))
        return DATE, at.isoformat(timespec="milliseconds")
    number = float(value)
    if is_date:
        at = epoch + datetime.timedelta(milliseconds=round(number * 86_400_000))
        return DATE, at.isoformat(timespec="milliseconds")
    return NUMBER, _number_text(number)


def _text_of(element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{_NS}t"))


def read_cells(content: bytes) -> Iterator[tuple]:
    """(sheet index, sheet, row, column, kind, text) of every non-empty cell of one workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [_text_of(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(book.read("xl/styles.xml"))
            codes = {int(e.get("numFmtId")): e.get("formatCode") for e in styles.iter(f"{_NS}numFmt")}
            for xfs in styles.iter(f"{_NS}cellXfs"):
                dates = [_is_date_format(int(x.get("numFmtId", 0)), codes.get(int(x.get("numFmtId", 0)))) for x in xfs]
        workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
        props = workbook.find(f"{_NS}workbookPr")
        epoch = _EPOCH_1904 if props is not None and props.get("date1904") in ("1", "true") else _EPOCH
        relations = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        targets = {r.get("Id"): r.get("Target") for r in relations}
        for index, sheet in enumerate(workbook.iter(f"{_NS}sheet")):
            target = targets[sheet.get(_REL)]
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            title, row, at = sheet.get("name"), 0, 0
            yield index, title, 0, 0, None, None
            with book.open(part) as stream:
                for event, e in ElementTree.iterparse(stream, events=("start", "end")):
                    if event == "start":
                        if e.tag == f"{_NS}row":
                            row = int(e.get("r") or row + 1)
                            at = 0
                        continue
                    if e.tag == f"{_NS}c":
                        at = _column_index(e.get("r")) if e.get("r") else at + 1
                        kind = e.get("t", "n")
                        inline = e.find(f"{_NS}is")
                        value = _text_of(inline) if inline is not None else e.findtext(f"{_NS}v")
                        style = int(e.get("s", 0))
                        cell = _cell(kind, value, style < len(dates) and dates[style], shared, epoch)
                        if cell is not None:
                            yield index, title, row, at, *cell
                    elif e.tag == f"{_NS}row":
                        e.clear()


def _cells_of_files(batches):
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            chunk: list[tuple] = []
            try:
                for cell in read_cells(content):
                    chunk.append((path, *cell, None))
                    if len(chunk) == 50_000:
                        yield pd.DataFrame(chunk, columns=_FIELDS)
                        chunk = []
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError) as failure:
                # Encrypted, damaged, or not a workbook: named, and none of its cells kept.
                chunk.append((path, -1, "", 0, 0, None, None, type(failure).__name__))
            yield pd.DataFrame(chunk, columns=_FIELDS)


_FIELDS = ["file", "sheet_index", "sheet", "row", "col", "kind", "text", "problem"]


def workbook_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path`` and ``content`` of the workbooks under a folder or glob."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")


def workbook_cells(files: DataFrame) -> DataFrame:
    """Every non-empty cell of every sheet of every workbook, one row each (and one row 0 per sheet)."""
    return files.select("path", "content").mapInPandas(_cells_of_files, CELL_SCHEMA)


def unreadable_workbooks(files: DataFrame) -> DataFrame:
    """``file`` and ``problem`` of every workbook that can't be opened."""
    return workbook_cells(files).where(F.col("problem").isNotNull()).select("file", "problem")


@dataclass(frozen=True)
class WorkbookSource:
    table: Table
    sheet: str | None
    header_row: int | None
    diagnostics: tuple[R.Diagnostic, ...]


def read_workbooks(files: DataFrame, sheet: str | None = None, header_row: int | None = None) -> WorkbookSource:
    """One sheet of every workbook (``workbook_files``) as one table. Without a name the first sheet is taken.

    The header is the first row of the most frequent width (counted in non-empty cells). A column of one kind keeps
    it; any time of day makes a date column a datetime; mixed kinds are text. A workbook that can't be opened refuses
    them all: the first one is named and they are counted, ``unreadable_workbooks`` has them all.
    """
    found: list[R.Diagnostic] = []
    # The files are unpacked once, into a table, not once per question.
    cells = stored(workbook_cells(files), "workbook-cells")
    broken = cells.where(F.col("problem").isNotNull()).agg(F.count(F.lit(1)).alias("files"), F.min(F.struct("file", "problem")).alias("first")).first()
    if broken["files"]:
        raise R.Refused([R.error("source.unreadable", file=broken["first"]["file"], reason=broken["first"]["problem"], files=broken["files"])])
    sheets = cells.where(F.col("row") == 0).select("file", "sheet_index", "sheet")
    picked = sheets.where(F.col("sheet") == sheet) if sheet else sheets.limit(0)
    fallback = sheets.where(F.col("sheet_index") == 0).join(picked.select("file"), "file", "left_anti")
    if sheet:
        lost = fallback.agg(F.count(F.lit(1)).alias("n"), F.min("sheet").alias("using")).first()
        if lost["n"]:
            found.append(R.warning("xlsx.sheet_missing", sheet=sheet, using=lost["using"], files=lost["n"]))
    chosen = picked.unionByName(fallback)
    body = cells.where((F.col("row") > 0) & (F.trim("text") != "")).join(
        chosen.select("file", "sheet_index"), ["file", "sheet_index"])
    rows = body.groupBy("file", "row").agg(F.count(F.lit(1)).alias("width"))
    per_file = rows.groupBy("file", "width").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row")).groupBy(
        "file").agg(F.max_by("row", F.struct("n", "width")).alias("header"))
    if header_row is not None:
        last = rows.groupBy("file").agg(F.max("row").alias("last"))
        per_file = last.select(
            "file", F.least(F.greatest(F.lit(int(header_row)), F.lit(1)), F.col("last")).alias("header"))
    heads = body.join(per_file, "file").where(F.col("row") == F.col("header"))
    layouts = heads.groupBy("file", "header").agg(
        F.array_sort(F.collect_list(F.struct("col", "text"))).alias("cells")
    ).groupBy("cells").agg(F.min("header").alias("header")).limit(2).collect()
    if not layouts:
        title = chosen.agg(F.min("sheet").alias("s")).first()["s"]
        found.append(R.warning("xlsx.empty", sheet=title or ""))
        return WorkbookSource(Table(cells.select().limit(0), ()), title, None, tuple(found))
    if len(layouts) > 1:
        raise R.Refused([R.error(
            "xlsx.headers_differ", first=[c["text"] for c in layouts[0]["cells"]],
            other=[c["text"] for c in layouts[1]["cells"]])])
    by_col = {c["col"]: c["text"] for c in layouts[0]["cells"]}
    # The sheet is as wide as its widest row, so data under a blank header is not lost.
    width = body.agg(F.max("col").alias("w")).first()["w"]
    given = [by_col.get(i, "") for i in range(1, width + 1)]
    blank = [i for i, n in enumerate(given, start=1) if n.strip() == ""]
    if blank:
        found.append(R.warning("xlsx.blank_header", columns=blank))
    repeated = [n for n in dict.fromkeys(given) if n and given.count(n) > 1]
    if repeated:
        found.append(R.warning("xlsx.duplicate_header", columns=repeated))
    names, renamed = unique_columns(given)
    if renamed:
        found.append(R.warning("source.columns_renamed", renamed=renamed))

    data = body.join(per_file, "file").where((F.col("row") > F.col("header")) & (F.col("col") <= width))
    kinds = data.groupBy("col").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") != TEXT, F.col("kind")))).alias("kinds"),
        R.count_if((F.col("kind") == DATE) & ~F.col("text").endswith("T00:00:00.000")).alias("timed"),
        R.count_if(F.col("kind") == TEXT).alias("strays"),
    ).collect()
    types = {i: TEXT for i in range(1, width + 1)}
    mixed = []
    for r in kinds:
        if len(r["kinds"]) == 1:
            only = r["kinds"][0]
            types[r["col"]] = DATETIME if only == DATE and r["timed"] else only
        elif len(r["kinds"]) > 1:
            mixed.append(R.warning("xlsx.mixed_types", column=names[r["col"] - 1], kinds=r["kinds"]))
    found += mixed

    keys = (OrderKey(f"{ORDER_PREFIX}0"), OrderKey(f"{ORDER_PREFIX}1"))
    wide = data.groupBy("file", "row").pivot("col", list(range(1, width + 1))).agg(
        F.first(F.struct("kind", "text")))
    exprs, cols, taken = [], [], set(names)
    for i, name in enumerate(names, start=1):
        cell, kind = F.col(f"`{i}`"), types[i]
        value, raw = _typed(cell, kind)
        exprs.append(value.alias(name))
        boxed = kind != TEXT and any(r["col"] == i and r["strays"] for r in kinds)
        if boxed:
            companion = free_name(f"{name}__raw", taken)
            exprs.append(box_of(raw, name, companion))
        cols.append(Col(name, kind, companion if boxed else None))
    # Rows between the first and the last that hold no cell at all are rows of the sheet too.
    spans = body.groupBy("file").agg(F.max("row").alias("last")).join(per_file, "file")
    every = spans.where(F.col("last") > F.col("header")).select(
        "file", F.explode(F.sequence(F.col("header") + 1, F.col("last"))).alias("row"))
    df = every.join(wide, ["file", "row"], "left").select(*exprs, F.col("file").alias(keys[0].name), F.col("row").alias(keys[1].name))
    title = chosen.agg(F.min("sheet").alias("s")).first()["s"]
    return WorkbookSource(Table(df, tuple(cols), keys), title, layouts[0]["header"], tuple(found))


def _typed(cell, kind: str):
    """(value, box text) of a pivoted cell under its column's kind. Stray text in a typed column is a box."""
    text = cell["text"]
    if kind == TEXT:
        plain = F.when(
            cell["kind"] == DATE, F.regexp_replace(text, r"T00:00:00\.000\z", "")).otherwise(text)
        return F.coalesce(plain, F.lit("")), None
    own = cell["kind"] == (DATE if kind == DATETIME else kind)
    cast = {NUMBER: "double", BOOLEAN: "boolean", DATE: "date", DATETIME: "timestamp_ntz"}[kind]
    return F.when(own, text.try_cast(cast)), F.when(~own & ~is_missing(trimmed(text)), text)
