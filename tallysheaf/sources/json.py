"""JSON in: strict first, nothing repaired unasked, nested values flattened the way the user chose."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import report as R
from ..naming import unique_columns
from ..plans.session import ship
from ..plans.storage import shared_folder, stored
from ..table import ORDER_PREFIX, OrderKey, Table, col
from .documents import elements

NDJSON, DOCUMENT, UNSUPPORTED, MALFORMED, EMPTY = "ndjson", "document", "unsupported_shape", "malformed", "empty"
ARRAYS = ("json", "index", "explode")


def _kind(variant: Column) -> Column:
    """OBJECT, ARRAY or a scalar's name, off the top of a parsed value."""
    schema = F.schema_of_variant(variant)
    return F.when(schema.startswith("OBJECT"), "OBJECT").when(schema.startswith("ARRAY"), "ARRAY").otherwise(schema)


def _complete(text: Column) -> Column:
    """The parsed value of a text that is one JSON value and nothing more; NULL otherwise.

    The parser stops behind a first value and takes no notice of the rest. In a list and in an object the rest shows:
    no text closes both early.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    held = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    one = listed.isNotNull() & held.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(one, F.try_variant_get(listed, "$[0]", "variant"))


def _maybe_object(text: Column) -> Column:
    """The text where it may be one object, NULL where its ends say that it isn't: most lines of a document are parts of a
    value, and each would cost the parser two failures."""
    ends = F.btrim(text, F.lit(" \t\r\n"))
    return F.when(ends.startswith("{") & ends.endswith("}"), text)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every line's place and whether it is blank, an object, or begins a list; written once, with the text of damaged ones
    only, so that each line is parsed once for all questions."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), F.col("value").alias("raw"))
    trimmed = F.trim("raw")
    judged = lines.withColumn("blank", trimmed == "").withColumn("list", trimmed.startswith("[")).withColumn(
        "object", F.coalesce(_kind(_complete(_maybe_object(trimmed))) == "OBJECT", F.lit(False)))
    # A file that isn't read by line is read by its elements: only lines that may be damaged records keep their text.
    kept = F.when(~F.col("blank") & ~F.col("object"), F.col("raw"))
    return stored(judged.select("file", "block", "id", "blank", "list", "object", kept.alias("raw")), "judged-lines")


def _files(lines: DataFrame) -> DataFrame:
    """One row per file: ``file``, ``by_line`` (its lines are objects, but for damaged ones) and ``bad`` lines.

    Told by the first line, or by most lines where that one is damaged, so that a large line-delimited file is never
    opened whole.
    """
    said = lines.where(~F.col("blank"))
    first = F.min_by(F.struct("object", "list"), F.struct("block", "id"))
    files = said.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), R.count_if(F.col("object")).alias("objects"), first.alias("first"))
    by_line = F.col("first.object") | ((F.col("objects") * 2 > F.col("n")) & ~F.col("first.list"))
    return files.select("file", by_line.alias("by_line"), (F.col("n") - F.col("objects")).alias("bad"))


def json_quarantine(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The damaged lines of line-delimited files: ``file``, ``line`` (from 1), ``raw``. They feed ``reread_lenient``."""
    return _quarantine(_lines(spark, path))


def _quarantine(lines: DataFrame) -> DataFrame:
    splits = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    damaged = lines.where(~F.col("blank") & ~F.col("object")).select("file", "block", "id", "raw")
    of = _files(lines).where("by_line AND bad > 0").select("file")
    return damaged.join(of, "file").join(offsets, ["file", "block"]).select(
        "file", (F.col("offset") + F.col("id") - F.col("first") + 1).alias("line"), "raw")


def json_shapes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file: ``file``, ``shape``, ``line``, ``position`` (where strict parsing stopped first, if it did).

    Every line is parsed on its own: a file of objects, a line each, is line-delimited, and malformed where a line is
    damaged. The other files are taken apart in splits; only those that are neither a sound array of objects nor one
    object are opened whole, to say what is wrong with them.
    """
    ship(spark)
    lines = _lines(spark, path)
    return _shapes(spark, lines, _documents(spark, lines))


def _documents(spark: SparkSession, lines: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The elements of the files that aren't line-delimited, and whether a file's are all sound objects; None without such
    files."""
    # A document is one value; as many names pass the driver as Spark's own list of files has.
    others = [r["file"] for r in _files(lines).where("NOT by_line").select("file").collect()]
    if not others:
        return None
    parts, shaped = elements(spark, others)
    judged = stored(parts.withColumn("sound", F.coalesce(_kind(_complete(F.trim("text"))) == "OBJECT", F.lit(False))), "judged-elements")
    files = shaped.join(judged.groupBy("file").agg(F.bool_and("sound").alias("sound")), "file", "left")
    return judged, files.select("file", (F.col("shape").isNotNull() & F.coalesce("sound", F.lit(False))).alias("sound"))


def _shapes(spark: SparkSession, lines: DataFrame, documents: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    files = _files(lines)
    nd = files.where("by_line")
    damaged = _quarantine(lines).groupBy("file").agg(F.min_by("raw", "line").alias("v"), F.min("line").alias("from_line"))
    located = damaged.mapInPandas(_locate, "file string, line bigint, position bigint")
    shapes = nd.select("file", F.when(F.col("bad") > 0, MALFORMED).otherwise(NDJSON).alias("shape")).join(located, "file", "left")
    if documents is None:
        return shapes
    known = files.where("NOT by_line").select("file").join(documents[1], "file", "left")
    sound = known.where("sound").select("file", F.lit(DOCUMENT).alias("shape"), F.lit(None).cast("bigint").alias("line"), F.lit(None).cast("bigint").alias("position"))
    shapes = shapes.unionByName(sound)
    others = [r["file"] for r in known.where("NOT coalesce(sound, false)").select("file").collect()]
    if not others:
        return shapes
    judged = spark.read.text(others, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.trim("value").alias("v"))
    judged = judged.withColumn("j", _complete(F.col("v")))
    # An array of objects, or one object, is a table; anything else that parses is not.
    elements = F.schema_of_variant("j")
    table_like = elements.startswith("OBJECT") | elements.startswith("ARRAY<OBJECT")
    rest = judged.select(
        "file",
        F.when(F.coalesce("v", F.lit("")) == "", EMPTY).when(F.col("j").isNull(), MALFORMED)
        .when(table_like, DOCUMENT).otherwise(UNSUPPORTED).alias("shape"), "v")
    located = rest.where(F.col("shape") == MALFORMED).select(
        "file", "v", F.lit(1).cast("bigint").alias("from_line")).mapInPandas(_locate, "file string, line bigint, position bigint")
    return shapes.unionByName(rest.select("file", "shape").join(located, "file", "left"))


def _locate(batches):
    """Line and column at which a malformed text stops being JSON; its first line is line ``from_line`` of the file."""
    for pdf in batches:
        lines, columns = [], []
        for text, start in zip(pdf["v"], pdf["from_line"], strict=True):
            try:
                json.loads(text)
                lines.append(start)
                columns.append(None)
            except json.JSONDecodeError as failure:
                lines.append(start + failure.lineno - 1)
                columns.append(failure.colno)
            except RecursionError:
                lines.append(None)
                columns.append(None)
        out = pdf[["file"]].copy()
        out["line"], out["position"] = lines, columns
        yield out.astype({"line": "Int64", "position": "Int64"})


def _refused(shapes: DataFrame, forgiven: DataFrame | None) -> DataFrame:
    refused = shapes.where(F.col("shape").isin(MALFORMED, UNSUPPORTED))
    return refused if forgiven is None else refused.join(forgiven, "file", "left_anti")


def json_refusals(spark: SparkSession, path: str | list[str], set_aside: bool = False) -> DataFrame:
    """Every file that ``read_json`` refuses: ``file``, ``code``, and ``line`` and ``position`` where its text stops being JSON."""
    ship(spark)
    lines = _lines(spark, path)
    forgiven = _quarantine(lines).select("file").distinct() if set_aside else None
    return _refused(_shapes(spark, lines, _documents(spark, lines)), forgiven).select("file", F.concat(F.lit("json."), "shape").alias("code"), "line", "position")


def read_json(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, arrays: str = "json",
    set_aside: bool = False,
) -> tuple[Table, list[R.Diagnostic]]:
    """JSON files as one flat table. Malformed files and unsupported shapes are different refusals, naming the file.

    With ``set_aside`` the damaged lines of line-delimited files are left out and counted instead of refused;
    ``json_quarantine`` has them. A refusal names the first file of each kind and says how many there are;
    ``json_refusals`` has them all.
    """
    ship(spark)
    lines = _lines(spark, path)
    documents = _documents(spark, lines)
    shapes = stored(_shapes(spark, lines, documents), "shapes")
    quarantine = _quarantine(lines)
    aside = quarantine.count() if set_aside else 0
    refused = _refused(shapes, quarantine.select("file").distinct() if aside else None)
    first = F.min_by(F.struct("file", "line", "position"), "file").alias("first")
    bad = refused.groupBy("shape").agg(F.count(F.lit(1)).alias("files"), first).orderBy("shape").collect()
    if bad:
        raise R.Refused([R.error(f"json.{r['shape']}", **r["first"].asDict(), files=r["files"]) for r in bad])
    kinds = {r["shape"] for r in shapes.select("shape").distinct().collect()} - {EMPTY}
    kinds = {NDJSON if k == MALFORMED else k for k in kinds}
    if len(kinds) > 1:
        raise R.Refused([R.error("json.mixed_shapes", shapes=sorted(kinds))])
    mode = "DROPMALFORMED" if aside else "FAILFAST"
    reader = spark.read.option("mode", mode)
    if kinds == {DOCUMENT}:
        return _flat_table(_from_elements(spark, documents[0], schema), arrays, aside)
    if aside:
        # The reader would take the first value of a damaged line: only whole lines are handed to the parser.
        fields = schema or reader.json(path).schema
        whole = spark.read.text(path).where(_kind(_complete(F.trim("value"))) == "OBJECT")
        df = whole.select(F.from_json("value", fields).alias("v"), "_metadata").select("v.*", "_metadata")
    else:
        df = (reader.schema(schema) if schema is not None else reader).json(path).select("*", "_metadata")
    position = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    placed = df.select(*[c for c in df.columns if c != "_metadata"], *[p.alias(f"{ORDER_PREFIX}{i}") for i, p in enumerate(position)])
    return _flat_table(placed, arrays, aside)


def _from_elements(spark: SparkSession, parts: DataFrame, schema: T.StructType | str | None) -> DataFrame:
    """Documents as the rows of their elements, in their order. What types they have is asked of all of them, as lines."""
    if schema is None:
        folder = f"{shared_folder(spark)}/element-lines-{uuid.uuid4().hex}"
        parts.select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).write.text(folder)
        schema = spark.read.option("mode", "FAILFAST").json(folder).schema
    read = parts.select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("v"), "file", "line", "column")
    return read.select("v.*", *[F.col(c).alias(f"{ORDER_PREFIX}{i}") for i, c in enumerate(("file", "line", "column"))])


def _flat_table(placed: DataFrame, arrays: str, aside: int) -> tuple[Table, list[R.Diagnostic]]:
    keys = tuple(OrderKey(f"{ORDER_PREFIX}{i}") for i in range(3))
    flat, renamed = flatten_json(placed, arrays, keep=[k.name for k in keys])
    order = [*keys, *[OrderKey(n) for n in flat.columns if n.startswith(f"{ORDER_PREFIX}e")]]
    table = Table.of(flat)
    found = [R.warning("source.columns_renamed", renamed=renamed)] if renamed else []
    if aside:
        found.append(R.warning("json.lines_set_aside", lines=aside))
    return table.with_df(flat, order=tuple(order)), found


def flatten_json(df: DataFrame, arrays: str = "json", keep: list[str] = ()) -> tuple[DataFrame, list[dict]]:
    """Objects become dot-path columns; arrays become JSON text (``json``), one column per position (``index``) or
    one row per element (``explode``). Returns the flat frame and the columns renamed to stay unique."""
    if arrays not in ARRAYS:
        raise ValueError(f"unknown array strategy: {arrays}")
    paths: list[tuple[str, Column, T.DataType]] = [
        (f.name, col(f.name), f.dataType) for f in df.schema.fields if f.name not in keep]
    keep = list(keep)
    exploded = 0
    while True:
        paths = _open_structs(paths)
        nested = [i for i, (_, _, t) in enumerate(paths) if isinstance(t, T.ArrayType)]
        if not nested or arrays == "json":
            break
        if arrays == "index":
            df, paths = _indexed(df, paths, keep, nested)
            continue
        # One row per element; an empty or missing array keeps its row.
        at = nested[0]
        index = f"{ORDER_PREFIX}e{exploded}"
        exploded += 1
        slots = [f"__p{i}" for i in range(len(paths))]
        others = [expr.alias(slot) for i, ((_, expr, _), slot) in enumerate(zip(paths, slots)) if i != at]
        df = df.select(*map(col, keep), *others, F.posexplode_outer(paths[at][1]).alias(index, slots[at]))
        keep.append(index)
        paths = [
            (name, col(slot), t.elementType if i == at else t)
            for i, ((name, _, t), slot) in enumerate(zip(paths, slots))
        ]
    names, renamed = unique_columns([name for name, _, _ in paths])
    exprs = [
        (F.to_json(e) if isinstance(t, (T.ArrayType, T.MapType, T.VariantType)) else e).alias(n)
        for n, (_, e, t) in zip(names, paths)
    ]
    return df.select(*exprs, *map(col, keep)), renamed


def _open_structs(paths):
    out = []
    for name, expr, data_type in paths:
        if isinstance(data_type, T.StructType):
            out += _open_structs([(f"{name}.{f.name}", expr.getField(f.name), f.dataType) for f in data_type.fields])
        else:
            out.append((name, expr, data_type))
    return out


def _indexed(df: DataFrame, paths, keep, nested):
    """One column per position: the longest array decides how many, in one aggregate for all arrays."""
    sizes = df.agg(*[F.max(F.size(paths[i][1])).alias(f"s{i}") for i in nested]).first()
    out = []
    for i, (name, expr, data_type) in enumerate(paths):
        if i in nested:
            out += [(f"{name}.{k}", F.get(expr, F.lit(k)), data_type.elementType) for k in range(sizes[f"s{i}"] or 0)]
        else:
            out.append((name, expr, data_type))
    return df, out


# ---- lenient re-reading, on request only -----------------------------------------------------------------------

# A complete JSON string, stepped over whole so that nothing inside one is touched.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
# Quotation marks that stand in for a plain double quote.
SMART_QUOTES = "[“”„‟]"


def _outside_strings(text: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(text, rf"({_STRING})|(?:{pattern})", "$1" + replacement)


def lenient_text(raw: Column) -> Column:
    """The text with its regular damage undone: code fences, smart quotes, ellipses, trailing commas.

    Comments, unquoted keys and single quotes are left to the parser, which can be told to accept them.
    """
    text = F.regexp_replace(raw, r"(?s)\A\s*```[A-Za-z0-9]*\s*\n(.*?)\n?\s*```\s*\z", "$1")
    # A smart quote outside a string opens or closes one.
    text = F.when(text.rlike(SMART_QUOTES), _smart(text)).otherwise(text)
    text = _outside_strings(text, r",?\s*(?:\.\.\.|…)\s*(?=[}\]])")
    return _outside_strings(text, r",(?=\s*[}\]])")


def _smart(text: Column) -> Column:
    """Plain quotes around smart-quoted spans - unless a plain string holds smart quotes as its own text."""
    spans = F.regexp_replace(text, rf"{SMART_QUOTES}([^“”„‟\"]*){SMART_QUOTES}", '"$1"')
    inside = text.rlike(rf'"[^"]*{SMART_QUOTES}[^"]*"')
    return F.when(inside, text).otherwise(spans)


def reread_lenient(quarantine: DataFrame, schema: T.StructType | str, raw: str = "raw") -> DataFrame:
    """Set-aside records read again: ``before`` (kept), ``after``, ``changed``, ``repaired`` and the parsed ``value``.

    The original text is never altered. A record that still does not read has a NULL value and stays set aside, and so
    does one with anything after its value: a second record would be lost.
    """
    options = {
        "allowComments": "true", "allowUnquotedFieldNames": "true", "allowSingleQuotes": "true",
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt",
    }
    before = col(raw)
    after = lenient_text(before)
    fields = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    watched = T.StructType([*fields.fields, T.StructField("_corrupt", T.StringType())])
    read = quarantine.withColumn("before", before).withColumn("after", after).withColumn(
        "read", F.from_json("after", watched, options))
    # As in _complete, under the lenient options; a comment at the end must not swallow the closing bracket.
    listed = F.from_json(F.concat(F.lit("["), "after", F.lit("\n]")), "array<string>", options)
    held = F.from_json(F.concat(F.lit('{"v":'), "after", F.lit("\n}")), "v string, _corrupt string", options)
    one = F.coalesce((F.size(listed) == 1) & held.isNotNull() & held["_corrupt"].isNull(), F.lit(False))
    ok = F.col("read").isNotNull() & F.col("read._corrupt").isNull() & one
    value = F.struct(*[F.col("read").getField(f.name).alias(f.name) for f in fields.fields])
    others = [col(c) for c in quarantine.columns if c != raw]
    return read.select(
        *others, "before", "after", (F.col("before") != F.col("after")).alias("changed"),
        ok.alias("repaired"), F.when(ok, value).alias("value"))
