import copy

import duckdb
import pytest

from tallysheaf import report as R
from tallysheaf.plans import recipe as recipes
from tallysheaf.plans.contract import Requirement, preflight
from tallysheaf.plans.detect import detect_types
from tools.compare import TABLES, normalised
from workload.oracles import ORACLES
from workload.queries import QUERIES, recipe

SF = "/root/testdata/sf0.001"


def faults(**changes):
    r = copy.deepcopy(recipe())
    r.update(changes)
    return [d.code.removeprefix("recipe.") for d in recipes.validate(r)]


def test_structure_is_checked_whole():
    assert recipes.validate(recipe()) == []
    steps = recipe()["steps"]
    assert faults(format="other@9") == ["unknown_version"]
    assert faults(result="orders") == ["result_is_source"]
    assert faults(result="nope") == ["missing_result"]
    assert faults(extra=1) == ["unrecognised_field"]
    assert faults(steps=steps + [steps[0]]) == ["duplicate_id"]
    assert faults(steps=steps + [{"id": "p", "kind": "pivot", "inputs": "orders"}]) == ["unknown_kind"]
    assert faults(steps=steps + [{"id": "p", "kind": "join", "inputs": ["orders"]}]) == ["wrong_arity"]
    assert faults(steps=steps + [{"id": "p", "kind": "sort", "inputs": "ghost"}]) == ["dangling_input"]
    loop = [{"id": "a", "kind": "sort", "inputs": "b"}, {"id": "b", "kind": "sort", "inputs": "a"}]
    assert faults(steps=steps + loop) == ["cycle"]


def small(make, **steps):
    return {"format": recipes.FORMAT, "name": "t", "sources": [{"id": "s"}],
            "steps": [{"id": k, **v} for k, v in steps.items()], "result": list(steps)[-1]}


def test_values_are_settled_by_named_rules(make):
    t = make("n double, d date", [(1500.0, None), (500.0, None)])
    ask = lambda column, value: recipes.run(
        small(make, f={"kind": "filter", "inputs": "s", "config": {
            "combine": "all", "conditions": [{"column": column, "op": "gt", "value": value}]}}), {"s": t}, counts=False)
    assert ask("n", "1000").table.df.count() == 1
    for column, value, code in (("n", "1.000,5", "recipe.display_form"), ("d", "31.12.2025", "recipe.date_not_iso"),
                                ("n", "2025-12-31", R.TYPE_MISMATCH)):
        outcome = ask(column, value)
        assert outcome.table is None
        assert [d.code for d in outcome.report.diagnostics()] == [code, R.RUN_INCOMPLETE]


def test_a_failed_step_stops_only_what_depends_on_it(make):
    t = make("n double", [(1.0,), (2.0,)])
    outcome = recipes.run(small(
        make,
        ok={"kind": "sort", "inputs": "s", "config": {"keys": [{"column": "n"}]}},
        bad={"kind": "columns", "inputs": "s", "config": {"columns": [{"from": "zzz"}]}},
        end={"kind": "union", "inputs": ["ok", "bad"]},
    ), {"s": t})
    assert outcome.table is None and outcome.tables["ok"] is not None
    assert [(d.step, d.code) for d in outcome.report.diagnostics()] == [
        ("bad", R.UNKNOWN_COLUMN), ("end", R.INPUT_FAILED), (None, R.RUN_INCOMPLETE)]
    with pytest.raises(R.Refused) as refusal:
        recipes.run(small(make, f={"kind": "sort", "inputs": "s"}), {"s": None})
    assert refusal.value.diagnostics[0].code == R.SOURCE_UNCONFIRMED


def test_probe_reports_a_large_result_instead_of_printing_it(make):
    t = make("n double", [(float(i),) for i in range(9)])
    ask = small(make, f={"kind": "sort", "inputs": "s", "config": {"keys": [{"column": "n", "direction": "desc"}]}})
    assert [r["n"] for r in recipes.probe(ask, {"s": t}, 9)[0].collect()][:2] == [8.0, 7.0]
    none, outcome = recipes.probe(ask, {"s": t}, 8)
    assert none is None and outcome.report.diagnostics()[0].code == R.RESULT_TOO_LARGE


def test_counts_survive_a_branch_the_runtime_skips(spark, make):
    from tallysheaf.operators.join import join_tables

    report = R.Report()
    empty = make("k int", [(1,)]).with_df(make("k int", [(1,)]).df.where("k < 0"))
    join_tables(empty, make("k int", [(1,), (2,)]), [{"left": "k", "right": "k"}], "inner", report=report).frame().collect()
    assert report.diagnostics() == []


def test_preflight(make):
    typing = detect_types(make("a string, b string", [("1,5", "x"), ("abc", "y")]))
    check = preflight([Requirement("s", "a", "number", "de-DE"), Requirement("s", "b"), Requirement("s", "c"),
                       Requirement("s", "d", optional=True)], {"s": typing})
    assert [(f.verdict, f.hit_rate) for f in check.findings] == [("doubtful", 0.5), ("fits", 1.0), ("missing", None)]
    assert check.blocked and check.findings[2].available == ("a", "b")


@pytest.mark.parametrize("name", ["recipe_end_to_end", "recipe_report", "sort_stable", "join_nulls_match", "union_boxes",
                                  "filter_boxed", "aggregate_boxes", "computed_marked_empty", "csv_quarantine"])
def test_registered_query_agrees_with_its_sql(spark, name):
    import pandas as pd

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")
    try:
        frame = QUERIES[name](spark, SF)
        got = pd.DataFrame([tuple(r) for r in frame.collect()], columns=frame.columns, dtype=object)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = duck.execute(ORACLES[name])
    want = pd.DataFrame(cursor.fetchall(), columns=[d[0] for d in cursor.description], dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    assert normalised(got) == normalised(want)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_a_filter_without_counts_reaches_the_scan(spark):
    from tallysheaf.operators.filter import filter_rows
    from workload.inputs import table
    from workload.queries import cond

    for report in (None, R.Report()):
        t = filter_rows(table(spark, SF, "lineitem"), [cond("l_quantity", "gt", 45)], report=report)
        plan = t.df.select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThan(l_quantity,45.0)" in plan
        assert "l_comment" not in plan and "l_extendedprice" not in plan


def test_row_wise_steps_accept_a_stream(spark, tmp_path):
    from tallysheaf.streaming import apply_row_wise
    from tallysheaf.table import Table

    spark.range(10).selectExpr("cast(id as double) a", "cast(id % 3 as double) b").write.parquet(f"{tmp_path}/in")
    stream = Table.of(spark.readStream.schema("a double, b double").parquet(f"{tmp_path}/in"))
    out = apply_row_wise(stream, [
        {"kind": "filter", "config": {"combine": "all", "conditions": [{"column": "a", "op": "gte", "value": 5}]}},
        {"kind": "computed", "config": {"name": "q", "op": "divide", "inputs": ["a", "b"]}}])
    run = out.frame(companions=True).writeStream.format("memory").queryName("rows").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert {(r["a"], r["q"], r["q__raw"]) for r in spark.table("rows").collect()} == {
        (5.0, 2.5, None), (6.0, None, ""), (7.0, 7.0, None), (8.0, 4.0, None), (9.0, None, "")}
    with pytest.raises(R.Refused):
        apply_row_wise(stream, [{"kind": "sort", "config": {"keys": []}}])
