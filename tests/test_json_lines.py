"""Damaged JSON: nothing after a value is lost, and damaged lines are named or set aside."""

import pytest
from pyspark.sql import functions as F

from tallysheaf import report as R
from tallysheaf.sources import json as json_source


def test_complete_values_only(spark):
    texts = ['{"a":1}', '{"a":2}{"a":9}', '{"a":1} trailing', "1,2", "1] [2", '1} {"x":2', "[]", ' {"a": [1, {"b": null}]} ', "", "nul"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.ok for r in df.select("t", json_source._complete(F.trim("t")).isNotNull().alias("ok")).collect()}
    assert [t for t in texts if got[t]] == ['{"a":1}', "[]", ' {"a": [1, {"b": null}]} ']


def test_damaged_lines_are_named_then_set_aside(spark, tmp_path):
    path = str(tmp_path / "x.json")
    lines = ['{"a":1}', "", '{"a":2', '{"a":3}', '{"a":4}{"a":9}', '{"a":5,}']
    open(path, "w").write("\n".join(lines) + "\n")
    with pytest.raises(R.Refused) as refusal:
        json_source.read_json(spark, path)
    found = refusal.value.diagnostics[0]
    assert (found.code, found.values["line"]) == ("json.malformed", 3)
    table, said = json_source.read_json(spark, path, set_aside=True)
    assert [r.a for r in table.ordered().collect()] == [1, 3]
    assert [(d.code, d.values["lines"]) for d in said] == [("json.lines_set_aside", 3)]
    aside = json_source.json_quarantine(spark, path)
    assert [(r.line, r.raw) for r in aside.orderBy("line").collect()] == [(3, lines[2]), (5, lines[4]), (6, lines[5])]
    again = json_source.reread_lenient(aside, "a long").orderBy("line").collect()
    assert again[2].repaired and again[2].value.a == 5 and not again[0].repaired


def test_trailing_text_of_a_document_is_malformed(spark, tmp_path):
    path = str(tmp_path / "d.json")
    open(path, "w").write('[\n {"a": 1}\n] x\n')
    assert [(r.shape, r.line) for r in json_source.json_shapes(spark, path).collect()] == [("malformed", 3)]


def test_a_text_of_two_values_is_not_repaired(spark):
    whole = ['{"a":1,}', "{a:2} // note", "```json\n{'a':3}\n```", '{"a":4} /* [ */']
    more = ['{"a":4}{"a":9}', '{"a":4},{"a":9}', '{"a":4,} {"a":9}', "{a:4} trailing", '{"a":4}, "b": 9', '{"a":4}]', '{"a":4}} ', None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*whole, *more])], "i int, raw string")
    got = json_source.reread_lenient(df, "a long").orderBy("i").collect()
    assert [r.value.a for r in got[:4]] == [1, 2, 3, 4] and all(r.repaired for r in got[:4])
    assert [(r.repaired, r.value) for r in got[4:]] == [(False, None)] * len(more)
