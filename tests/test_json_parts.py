"""Lines that are parts of a value are told by their ends, without the parser."""

from pyspark.sql import functions as F

from tallysheaf.sources import json as json_source


def test_only_lines_that_may_be_objects_are_parsed(spark):
    parts = ["[", '{"a": 1,', '"b": {"c": 2}', '}, {"a": 3}, ', "]", "", "}", "{", '"{}"', None]
    whole = ['{"a": 1}', '\t{"a": 1}\r', " {} ", '{"a": 1}{"b": 2}', "{a}"]
    df = spark.createDataFrame([(t,) for t in [*parts, *whole]], "t string")
    kept = [r.t for r in df.where(json_source._maybe_object(F.col("t")).isNotNull()).collect()]
    assert sorted(kept) == sorted(whole)


def test_documents_and_lines_are_told_apart_as_before(spark, tmp_path):
    texts = {"lines": '\t{"a":1}\t\n{"a":2}\n', "document": '[\n{"a":1,\n "b":2},\n{"a":3}]\n', "damaged": '{"a":1}\n{"a":2}\n{"a":3}{"a":4}\n'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {r.file.rsplit("/", 1)[1]: (r.shape, r.line) for r in json_source.json_shapes(spark, str(tmp_path)).collect()}
    assert got == {"lines.json": ("ndjson", None), "document.json": ("document", None), "damaged.json": ("malformed", 3)}
