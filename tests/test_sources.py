import os

import pytest
from support import rows

from tallysheaf import report as R
from tallysheaf.naming import unique_columns
from tallysheaf.plans.convert import convert
from tallysheaf.plans.detect import detect_types
from tallysheaf.sources import csv, encoding, sinks, workbooks
from tallysheaf.sources import json as json_source
from tallysheaf.sources.parquet import read_parquet


@pytest.fixture
def put(tmp_path):
    def write(name, content):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(path)

    return write


def codes(source):
    return [d.code for d in source.diagnostics]


def test_unique_columns():
    assert unique_columns(["a", "", "a", "a_2", None])[0] == ["a", "col_2", "a_3", "a_2", "col_5"]
    assert unique_columns(["col_2", ""])[0] == ["col_2", "col_2_2"]


def test_short_and_long_records_are_set_aside_by_file_line(spark, put):
    s = csv.read_csv(spark, put("d.csv", 'Name,Ort,Betrag\n"A,\nB",B,1\nA,B\nC,D,2\nC,D,2,3\nE,F,3\n'))
    assert rows(s.table) == [("A,\nB", "B", "1"), ("C", "D", "2"), ("E", "F", "3")]
    assert [(r["row"], r["fields"], r["raw"]) for r in s.quarantine.orderBy("row").collect()] == [
        (4, 2, "A,B"), (6, 4, "C,D,2,3")]
    assert codes(s) == ["csv.field_count_mismatch"]


def test_an_unclosed_quote_is_named_and_kept_out(spark, put):
    s = csv.read_csv(spark, put("q.csv", 'a,b\n1,2\n3,"offen\n4,5\n6,7\n'))
    assert rows(s.table) == [("1", "2")]
    assert codes(s) == ["csv.unclosed_quote"] and s.diagnostics[0].values == {"row": 3}
    assert s.quarantine.count() == 3


def test_line_breaks_in_quotes_are_stitched_across_splits(spark, put):
    body = "".join(f'{i};"lang\nwort ""{i}""\n;{"x" * (i * 7)}"\n' for i in range(30))
    s = csv.read_csv(spark, put("m.csv", "a;b\n" + body))
    assert rows(s.table) == [(str(i), f'lang\nwort "{i}"\n;{"x" * (i * 7)}') for i in range(30)]


def test_headers_names_encodings_and_delimiters(spark, put):
    s = csv.read_csv(spark, put("h.csv", "Report vom 1.1.\n\na;b;a;\n1;2;3;4\n5;6;7;8\n"))
    assert (s.table.names, s.header_row, s.delimiter) == (["a", "b", "a_2", "col_4"], 3, ";")
    s = csv.read_csv(spark, put("w.csv", "Kunde;Straße;Betrag in €\nÄ;Öl;1,5\n".encode("cp1252")))
    assert (s.encoding, s.table.names, rows(s.table)) == (
        "windows-1252", ["Kunde", "Straße", "Betrag in €"], [("Ä", "Öl", "1,5")])
    s = csv.read_csv(spark, put("u.csv", "Ort;Wert\r\nKöln;1\r\n".encode("utf-16")))
    assert (s.encoding, rows(s.table)) == ("utf-16le", [("Köln", "1")])
    s = csv.read_csv(spark, put("b.csv", "﻿Ort;Wert\nKöln;1\n"))
    assert s.table.names == ["Ort", "Wert"]
    assert codes(csv.read_csv(spark, put("one.csv", "eins\nx\n"))) == ["csv.delimiter_undetectable"]
    assert codes(csv.read_csv(spark, put("e.csv", " \n"))) == ["csv.empty"]
    assert codes(csv.read_csv(spark, put("mq.csv", 'a,b\n"x"y,3\n'))) == ["csv.malformed_quote"]


def test_nul_bytes_raise_a_question(spark, put):
    found = csv.read_csv(spark, put("n.csv", "Ort;Wert\nA;1\n".encode("utf-16le")), delimiter=";")
    assert "encoding.nul_bytes" in codes(found)
    kinds = encoding.detect_encodings(spark, put("l.csv", "Ä\n".encode("cp1252"))).first()
    assert (kinds["encoding"], kinds["decided_by"]) == ("windows-1252", "fallback")


def test_json_shapes_flattening_and_repair(spark, put):
    nd = put("a.json", '{"a":1,"b":{"c":"x","d":[1,2]}}\n{"a":2,"b":{"c":"y","d":[]}}\n')
    read = lambda path, **k: json_source.read_json(spark, path, **k)[0]
    assert (read(nd).names, rows(read(nd))) == (["a", "b.c", "b.d"], [(1, "x", "[1,2]"), (2, "y", "[]")])
    assert rows(read(nd, arrays="index")) == [(1, "x", 1, 2), (2, "y", None, None)]
    assert rows(read(nd, arrays="explode")) == [(1, "x", 1), (1, "x", 2), (2, "y", None)]
    doc = put("b.json", '[\n {"a":1,"e":[{"k":1},{"k":2}]},\n {"a":2}\n]')
    assert rows(read(doc, arrays="explode")) == [(1, 1), (1, 2), (2, None)]
    with pytest.raises(R.Refused) as refusal:
        read(put("c.json", '{"a":1,\n "b": 2,,}\n'))
    assert (refusal.value.diagnostics[0].code, refusal.value.diagnostics[0].values["line"]) == ("json.malformed", 2)
    with pytest.raises(R.Refused) as refusal:
        read(put("s.json", "[1,2]"))
    assert refusal.value.diagnostics[0].code == "json.unsupported_shape"
    broken = ["```json\n{\"a\": 1,}\n```", "{a: 'x', /* c */ b: [1,2,]}", "{“a”: “z”}", '{"a":"x, ]"}', '{"b":[1, ...]}', '{"a":']
    out = json_source.reread_lenient(
        spark.createDataFrame([(i, t) for i, t in enumerate(broken)], "i int, raw string"), "a string, b array<int>")
    got = {r["i"]: (r["repaired"], r["changed"], r["value"]) for r in out.collect()}
    assert [got[i][0] for i in range(6)] == [True, True, True, True, True, False]
    assert got[3] == (True, False, ("x, ]", None)) and got[4][2]["b"] == [1]


def test_workbooks(spark, put):
    import datetime

    from workload.books import book_bytes

    day = datetime.datetime(2025, 8, 1)
    path = put("w.xlsx", book_bytes({
        "Daten": [["Titel"], ["Kunde", "Betrag", "Am", "ja"], ["Ä", 1234.5, day, True], ["B", "ungefähr", None, False],
                  ["C", -0.25, day, True]],
        "Zwei": [["x"], ["y"]]}))
    read = lambda p, **k: workbooks.read_workbooks(workbooks.workbook_files(spark, p), **k)
    s = read(path)
    assert (s.header_row, [(c.name, c.kind) for c in s.table.cols]) == (
        2, [("Kunde", "text"), ("Betrag", "number"), ("Am", "date"), ("ja", "boolean")])
    assert rows(s.table, True)[1] == ("B", None, "ungefähr", None, False)
    assert rows(s.table)[0] == ("Ä", 1234.5, datetime.date(2025, 8, 1), True)
    missing = read(path, sheet="Drei")
    assert codes(missing) == ["xlsx.sheet_missing"]
    with pytest.raises(R.Refused) as refusal:
        read(put("bad.xlsx", b"nope"))
    assert refusal.value.diagnostics[0].code == "source.unreadable"


def test_exports_load_back(spark, make, tmp_path):
    t = make("Kunde string, Betrag double, Betrag__raw string",
             [('Ä;"x"', 1234.5, None), ("B", None, "ungefähr"), ("C", None, None)] + [("D", 2.25, None)] * 20)
    sinks.write_csv(t, f"{tmp_path}/c")
    part = sorted(f for f in os.listdir(f"{tmp_path}/c") if f.endswith(".csv"))[0]
    assert open(f"{tmp_path}/c/{part}", "rb").read().startswith(b"\xef\xbb\xbfKunde;Betrag\n")
    s = csv.read_csv(spark, f"{tmp_path}/c")
    assert rows(convert(s.table, detect_types(s.table).confirm()), True) == rows(t, True)
    sinks.write_parquet(t, f"{tmp_path}/p")
    back = read_parquet(spark, f"{tmp_path}/p")[0]
    assert (back.cols, rows(back, True)) == (t.cols, rows(t, True))
    sinks.write_json(t, f"{tmp_path}/j")
    assert '{"Kunde":"B","Betrag":"ungefähr"}' in "".join(
        open(f"{tmp_path}/j/{f}").read() for f in os.listdir(f"{tmp_path}/j") if f.endswith(".json"))


def test_parquet_kinds(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({
        "id": pa.array([1, 2**60 + 1], pa.int64()), "preis": pa.array([None, "1.50"]).cast(pa.string()),
        "wann": pa.array([0, 1234567], pa.timestamp("us", tz="UTC")), "roh": pa.array([b"a", b"b"]),
        "nested": pa.array([{"a": 1}, None])}), f"{tmp_path}/t.parquet")
    t, found = read_parquet(spark, f"{tmp_path}/t.parquet")
    assert [c.kind for c in t.cols] == ["number", "text", "datetime", "text", "text"]
    assert sorted(d.code for d in found) == ["parquet.nested_column", "parquet.unsupported_type"]
    assert rows(t)[1][0] == 2**60 + 1 and rows(t)[0][4] == '{"a":1}'


def test_parquet_repeated_names_leave_the_others(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for kinds in ([pa.array([1]), pa.array(["x"])], [pa.array([1]), pa.array([2])]):
        pq.write_table(pa.Table.from_arrays([*kinds, pa.array([7]), pa.array([{"u": 1}])], names=["b", "b", "c", "s.t"]), f"{tmp_path}/d.parquet")
        t, found = read_parquet(spark, f"{tmp_path}/d.parquet")
        assert t.names == ["c", "s.t"] and rows(t) == [(7, '{"u":1}')]
        assert found[0].code == "parquet.duplicate_column_name" and found[0].values == {"column": "b", "columns": 2}


def test_parquet_codec_without_a_library(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"a": [1, 2]}), f"{tmp_path}/a.parquet", compression="brotli")
    with pytest.raises(R.Refused) as refusal:
        read_parquet(spark, f"{tmp_path}/a.parquet")
    assert [(d.code, d.values) for d in refusal.value.diagnostics] == [("parquet.unsupported_codec", {"codec": "BROTLI"})]


def test_parquet_nanoseconds_are_recognised(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    values = [0, 1, 1_700_000_000_123_456_789, -1, None, -1_500_000_000_000_000_123]
    pq.write_table(pa.table({"t": pa.array(values, pa.timestamp("ns")), "t__ns": pa.array(["own"] * 6), "n": pa.array(range(6))}), f"{tmp_path}/n.parquet")
    t, found = read_parquet(spark, f"{tmp_path}/n.parquet")
    assert [(c.name, c.kind, c.nanos) for c in t.cols] == [("t", "datetime", "t__ns_"), ("t__ns", "text", None), ("n", "number", None)]
    got = t.df.selectExpr("n", "unix_micros(cast(t as timestamp)) * 1000 + t__ns_ AS v").collect()
    assert {r.n: r.v for r in got} == dict(enumerate(values))


def test_delimiter_by_records_and_header_row_in_a_record(spark, put):
    cell = '"x;y;z\nu;v;w\np;q;r"'
    path = put("multi.csv", "a,b\n" + "".join(f"{i},{cell}\n" for i in range(12)))
    assert csv.propose_delimiters(spark, path).first()["delimiter"] == ","
    source = csv.read_csv(spark, path)
    assert [r.a for r in source.table.ordered().collect()] == [str(i) for i in range(12)]
    # Line 3 is inside the record that begins on line 2.
    assert csv.read_csv(spark, path, header_row=3).header_row == 2


def test_unclosed_quote_on_the_header_line(spark, put):
    source = csv.read_csv(spark, put("head.csv", '"a,b\n1,2\n3,4\n'), delimiter=",", header_row=1)
    found = next(d for d in source.diagnostics if d.code == "csv.unclosed_quote")
    assert found.values["row"] == 1
    assert '"a,b' in [r.raw for r in source.quarantine.collect()]
