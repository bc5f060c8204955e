"""Global positions, run counts per segment, and sources read in splits."""

import json
import random

import pytest
from pyspark.sql import functions as F
from support import rows

from tallysheaf import report as R
from tallysheaf.operators import first, profile, rank
from tallysheaf.operators.search import search_positions
from tallysheaf.operators.sort import sort_rows
from tallysheaf.plans.recipe import FORMAT, run
from tallysheaf.sources import csv, documents
from tallysheaf.sources import encoding as E
from tallysheaf.sources import json as json_source


@pytest.fixture
def people(make):
    rng = random.Random(4)
    return make("name string, age int, city string", [(f"n{rng.randrange(40)}", rng.choice([None, 1, 2, 3]), f"c{i % 7}") for i in range(300)])


def test_positions_are_those_of_a_sort(people):
    t = sort_rows(people, [{"column": "age", "direction": "desc"}, {"column": "name"}])
    plain = [tuple(r) for r in t.ordered().collect()]
    numbered = rank.with_rank(t).orderBy("rank").collect()
    assert [tuple(r)[:3] for r in numbered] == plain and [r["rank"] for r in numbered] == list(range(1, 301))
    assert rows(rank.ranked(t)) == plain


def test_many_first_rows_are_taken_by_position(people, monkeypatch):
    t = sort_rows(people, [{"column": "name"}])
    want = {n: {end: rows(first.first_rows(t, n, end)) for end in first.ENDS} for n in (7, 100, 1000)}
    deep = [tuple(r) for r in first.row_window(t, 120, 30)[0].collect()]
    monkeypatch.setattr(first, "TOP_N", 5)
    for n, ends in want.items():
        for end, expected in ends.items():
            taken = first.first_rows(t, n, end)
            assert rows(taken) == expected
            assert "TakeOrderedAndProject" not in taken.df._jdf.queryExecution().toString()
    assert [tuple(r) for r in first.row_window(t, 120, 30)[0].collect()] == deep


def test_search_tells_row_and_column_of_every_hit(make):
    t = make("a string, b double, c string", [("x1", 1.5, "y"), ("2", 2.0, "12"), (None, None, None), ("11", 10.0, "z1")])
    got = [tuple(r) for r in search_positions(t, "1").orderBy("hit").collect()]
    assert got == [(1, 1, 1, "a"), (2, 1, 2, "b"), (3, 2, 3, "c"), (4, 4, 1, "a"), (5, 4, 2, "b"), (6, 4, 3, "c")]
    assert search_positions(t, "nowhere").count() == 0


def test_distinct_values_without_rows_times_columns(people, make):
    odd = make("a double, b string, c boolean", [(0.0, "", True), (-0.0, None, None), (float("nan"), "x", False), (float("nan"), "x", True), (1e300, "0", None)])
    for t in (people, odd):
        told = profile.column_profile(t, "s")
        assert "Expand" not in told._jdf.queryExecution().toString()
        for r in told.collect():
            assert r["distinct_values"] == t.df.agg(F.count_distinct(F.col(r["column"]))).first()[0]
    assert profile.column_profile(odd.with_df(odd.df.limit(0)), "s").where("distinct_values <> 0").count() == 0


def test_counts_of_a_run_take_one_scan_per_source_and_segment(spark, tmp_path):
    from tallysheaf.table import Table

    for name in ("o", "c"):
        spark.range(500).select((F.col("id") % 50).alias("k"), F.col("id").cast("double").alias(f"v_{name}"), F.lit(0.0).alias(f"z_{name}")).write.parquet(f"{tmp_path}/{name}")
    sources = {n: Table.of(spark.read.parquet(f"{tmp_path}/{n}"), position=[F.col(f"v_{n}")]) for n in ("o", "c")}
    steps, last = [{"id": "j", "kind": "join", "inputs": ["o", "c"], "config": {"keys": [{"left": "k", "right": "k"}]}}], "j"
    for i in range(6):
        for kind, config in (("computed", {"name": f"n{i}", "op": "divide", "inputs": ["v_o", "z_o"]}),
                             ("filter", {"combine": "all", "conditions": [{"column": "v_c", "op": "gt", "value": 10 * i}]}),
                             ("sort", {"keys": [{"column": f"n{i}"}]})):
            steps.append({"id": f"{kind}{i}", "kind": kind, "inputs": last, "config": config})
            last = f"{kind}{i}"
    steps += [{"id": "g", "kind": "aggregate", "inputs": last, "config": {"by": ["k"], "aggs": [{"op": "count"}]}},
              {"id": "f", "kind": "filter", "inputs": "g", "config": {"combine": "all", "conditions": [{"column": "count", "op": "gt", "value": 50}]}},
              {"id": "r", "kind": "first", "inputs": "f", "config": {"count": 3}}]
    recipe = {"format": FORMAT, "name": "x", "sources": [{"id": "o"}, {"id": "c"}], "steps": steps, "result": "r"}
    outcome = run(recipe, sources)
    plan = outcome.report._tally_plan(sorted(outcome.report._trails, key=lambda t: -len(t.flags)))
    # After the join and after the grouping: two segments of two sources, whatever the number of steps.
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 4
    found = {(d.step, d.code): d.values for d in outcome.report.diagnostics()}
    assert found[("j", R.JOIN_GROWTH)]["after"] == 5000
    kept = 5000
    for i in range(6):
        now = 10 * (500 - 10 * i - 1)
        assert found[(f"filter{i}", R.ROWS_REMOVED)] == {"removed": kept - now, "kept": now}
        kept = now
        assert (f"sort{i}", R.BOXED_ROWS_LAST) in found and found[(f"computed{i}", R.COMPUTED_EMPTY)]["rows"] >= kept
    assert found[("g", R.AGGREGATE_ROWS)] == {"before": kept, "after": 50}
    assert found[("r", R.ROWS_REMOVED)]["kept"] == 3


def test_an_array_of_several_splits_is_read_by_several_tasks(spark, tmp_path):
    objects = [{"a": i, "s": 'x] } , "{[' * (i % 3), "n": {"m": [1, {"z": [i]}]}} for i in range(40)]
    path = str(tmp_path / "d.json")
    open(path, "w").write("\n [" + " ,\n".join(json.dumps(o, indent=i % 3) for i, o in enumerate(objects)) + "\n]\n \n")
    parts, shapes = documents.elements(spark, [path])
    assert [r.shape for r in shapes.collect()] == ["array"]
    assert [json.loads(r.text) for r in parts.orderBy("line", "column").collect()] == objects
    table, _ = json_source.read_json(spark, path)
    assert [r["a"] for r in table.ordered().collect()] == list(range(40))
    assert spark.read.text(path).rdd.getNumPartitions() > 8


@pytest.mark.parametrize("text,shape", [
    ('{"a":\n 1}', "document"), ('[{"a":1}\n{"a":2}]', "malformed"), ('[{"a":1},]', "malformed"), ("[\n]", "unsupported"), ('[{"a":1},\n 2]', "unsupported"),
    ('{"a":\n1}\n{"a":\n2}', "malformed"), ('[[{"a":\n1}]]', "unsupported"), ('[{"a":1},\n{"a":}]', "malformed"), ('[\n{"a":1}\n]]', "malformed"), ('"a\n b"', "malformed"),
    ('[{"a":"\n"}]', "malformed"), ("[\n{\"a\":1}", "malformed")])
def test_shapes_of_documents(spark, tmp_path, text, shape):
    path = str(tmp_path / "x.json")
    open(path, "w").write(text)
    found = json_source.json_shapes(spark, path).first()["shape"]
    assert found == {"unsupported": json_source.UNSUPPORTED}.get(shape, shape)


def test_utf16_is_read_in_splits_with_exact_lines(spark, tmp_path):
    rng = random.Random(1)
    alphabet = ["a", "ਊ", "Ā", "\u000d਀", "਀", "ä", ";", "Ċ", "0"]
    for codec in (E.UTF16LE, E.UTF16BE):
        lines = ["".join(rng.choices(alphabet, k=rng.randrange(20))) for _ in range(60)]
        path = str(tmp_path / f"{codec}.txt")
        open(path, "wb").write("\n".join(lines).encode(codec) + "\n".encode(codec))
        got = [r.text for r in csv.records(spark, path, "|", codec).orderBy("line").collect()]
        assert got == "\n".join(lines).replace("\r\n", "\n").replace("\r", "\n").split("\n")


def test_records_over_any_border_between_splits(spark, tmp_path):
    """Random quoted and damaged text, against one pass over the whole file by the same rules."""
    rng = random.Random(9)
    for k in range(3):
        text = "".join(rng.choices(['"', '""', ";", "\n", "x", "yy", '";"', '"\n', "\r\n"], k=160))
        path = str(tmp_path / f"{k}.csv")
        open(path, "w", newline="").write(text)
        lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        quotes, inside, held, want, start = csv.Quotes(";"), False, [], [], 0
        for i, line in enumerate(lines, 1):
            start = start if inside else i
            held.append(line)
            inside = quotes.after(line.encode(), inside)
            if not inside:
                want.append((start, "\n".join(held), False))
                held = []
        want += [(start + i, line, True) for i, line in enumerate(held)]
        got = [(r.line, r.text, r.unclosed) for r in csv.records(spark, path, ";").orderBy("line").collect()]
        assert got == want
