import pytest
from support import rows

from tallysheaf import report as R
from tallysheaf.operators import aggregate, computed, join, union
from tallysheaf.operators.search import search

KEY = [{"left": "k", "right": "k"}]


@pytest.fixture
def left(make):
    return make("k double, k__raw string, a string",
                [(1.0, None, "x"), (2.0, None, "y"), (None, None, "n"), (None, "zwei", "z"), (1.0, None, "w")])


@pytest.fixture
def right(make):
    return make("k double, k__raw string, a string",
                [(1.0, None, "R1"), (1.0, None, "R2"), (None, None, "RN"), (None, "zwei", "RB")])


def test_left_join_keeps_left_order_and_boxes_never_match(left, right):
    report = R.Report()
    t = join.join_tables(left, right, KEY, report=report)
    assert t.names == ["k", "a", "a_2"]
    assert [(r[1], r[2]) for r in rows(t)] == [
        ("x", "R1"), ("x", "R2"), ("y", None), ("n", None), ("z", None), ("w", "R1"), ("w", "R2")]
    found = {d.code: d.values for d in report.diagnostics()}
    assert found[R.JOIN_UNMATCHED] == {"rows": 3}
    assert found[R.JOIN_GROWTH] == {"before": 5, "after": 7, "factor": 1.4}
    assert found[R.JOIN_NULL_KEYS] == {"left": 1, "right": 1}


def test_nulls_match_on_request_but_boxes_do_not(left, right):
    t = join.join_tables(left, right, KEY, "inner", nulls_match=True)
    assert [(r[1], r[2]) for r in rows(t)] == [("x", "R1"), ("x", "R2"), ("n", "RN"), ("w", "R1"), ("w", "R2")]
    audit = {r["k"]: tuple(r)[1:] for r in join.duplicate_audit(left, right, KEY).collect()}
    assert audit == {1.0: (2, 2, 4)}
    counts = join.join_counts(left, right, KEY).first().asDict()
    assert (counts["rows_out"], counts["unmatched_left"]) == (7, 3)


def test_join_refusals(left, make):
    other = make("k string, b string", [("1", "q")])
    with pytest.raises(R.Refused) as refusal:
        join.join_tables(left, other, [{"left": "k", "right": "k"}, {"left": "nope", "right": "b"}])
    assert [d.code for d in refusal.value.diagnostics] == [R.TYPE_MISMATCH, R.UNKNOWN_COLUMN]


def test_a_skewed_key_is_joined_whole(spark, make):
    from pyspark.sql import functions as F

    from tallysheaf.table import Table

    hot = Table.of(spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id"))
    dim = Table.of(spark.range(9000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = join.join_tables(hot, dim, KEY).df
        assert out.count() == 9000 and out.where("v is null").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_union_maps_pads_drops_and_orders(make):
    a = make("KundenNr string, Betrag double, Betrag__raw string", [("1", 5.0, None), ("2", None, "viel")])
    b = make("Nr string, Betrag double, Region string", [("3", 7.0, "Süd")])
    mapping = [{"target": "KundenNr", "from": "Nr"}]
    report = R.Report()
    t = union.union_tables([a, b, a], mapping, report=report)
    assert rows(t, True) == [("1", 5.0, None, None), ("2", None, "viel", None), ("3", 7.0, None, "Süd"),
                             ("1", 5.0, None, None), ("2", None, "viel", None)]
    assert [d.code for d in report.diagnostics()] == [R.UNION_PARTIAL_COLUMNS, R.UNION_SAME_INPUT]
    assert union.union_tables([a, b], mapping, "drop").names == ["KundenNr", "Betrag"]
    with pytest.raises(R.Refused) as refusal:
        union.union_tables([a, make("KundenNr double", [(1.0,)])])
    assert refusal.value.diagnostics[0].code == R.TYPE_MISMATCH


def test_union_of_differently_ordered_inputs_keeps_each_order(make):
    from tallysheaf.operators.sort import sort_rows

    a = sort_rows(make("n int", [(1,), (3,), (2,)]), [{"column": "n", "direction": "desc"}])
    assert [r[0] for r in rows(union.union_tables([make("n int", [(9,), (7,)]), a]))] == [9, 7, 3, 2, 1]


def test_aggregate_groups_nulls_and_skips_boxes(left):
    report = R.Report()
    t = aggregate.aggregate(left, ["k"], [{"op": "count", "as": "n"}], report)
    assert sorted(((r[0], r[1], r[2]) for r in rows(t, True)), key=str) == sorted(
        [(1.0, None, 2), (2.0, None, 1), (None, None, 1), (None, "zwei", 1)], key=str)
    assert [d.values for d in report.diagnostics()] == [{"before": 5, "after": 4}]
    whole = aggregate.aggregate(left, [], [
        {"op": "sum", "column": "k", "as": "s"}, {"op": "count", "as": "n"},
        {"op": "count_distinct", "column": "k", "as": "d"}, {"op": "maximum", "column": "a", "as": "m"}])
    assert rows(whole) == [(4.0, 5, 2, "z")]
    with pytest.raises(R.Refused):
        aggregate.aggregate(left, [], [{"op": "average", "column": "a"}])


def test_computed_marks_what_cannot_be_computed(make):
    t = make("a double, a__raw string, b double", [(6.0, None, 3.0), (1.0, None, 0.0), (None, "x", 2.0), (None, None, 2.0)])
    quotient = computed.add_computed(t, "q", "divide", ["a", "b"])
    assert [r[3:] for r in rows(quotient, True)] == [(2.0, None), (None, ""), (None, ""), (None, None)]
    label = computed.add_computed(t, "l", "concat", ["a", "b"], "/")
    assert [r[2] for r in rows(label)] == ["6/3", "1/0", None, "2"]
    with pytest.raises(R.Refused) as refusal:
        computed.add_computed(t, "a", "add", ["a", "zz"])
    assert [d.code for d in refusal.value.diagnostics] == [R.UNKNOWN_COLUMN, R.RENAME_COLLISION]


def test_search_sees_cells_as_rendered(left):
    found = search(left, "zwei")
    assert [(r["a"], r["matched_columns"]) for r in found.df.collect()] == [("z", ["k"])]


def _sizes(df):
    from pyspark.sql import functions as F

    return [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_heavy_keys_of_either_side_are_dealt_to_several_tasks(spark):
    """A key with most rows of the right side, one with many of both, missing keys, and keys of one side only."""
    from pyspark.sql import functions as F

    from tallysheaf.table import Table

    ids = spark.range(4000)
    left = Table.of(spark.range(60).select(
        F.when(F.col("id") < 10, 0).when(F.col("id") < 30, 1).when(F.col("id") < 40, F.lit(None)).otherwise(F.col("id")).alias("k"), "id"))
    right = Table.of(ids.select(F.when(F.col("id") < 3000, 0).when(F.col("id") < 3100, 1).when(F.col("id") < 3300, F.lit(None)).otherwise(F.col("id") - 3260).alias("k"), F.col("id").alias("v")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for kind in ("left", "inner"):
            for nulls in (False, True):
                heavy = join.heavy_keys(left, right, KEY, nulls, rows_a_task=15)
                plain = join.join_tables(left, right, KEY, kind, nulls).frame()
                dealt = join.join_tables(left, right, KEY, kind, nulls, heavy=heavy).frame()
                assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
        heavy = join.heavy_keys(left, right, KEY, rows_a_task=500)
        assert [tuple(r) for r in heavy.collect()] == [(0, 0, 1, 6)]
        whole, split = (_sizes(join.join_tables(left, right, KEY, heavy=h).df) for h in (None, heavy))
        assert max(whole) >= 30_000 and max(split) < 20_000 and sum(whole) == sum(split)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rows_that_match_nothing_are_led_past_the_join(spark):
    """All rows of the left side share one key that the right side lacks: none of them is shuffled."""
    from pyspark.sql import functions as F

    from tallysheaf.table import Table

    left = Table.of(spark.range(3000).select(F.when(F.col("id") % 2 == 0, 7).alias("k"), "id"))
    right = Table.of(spark.range(10).select(F.col("id").cast("int").alias("k")).where("k <> 7"))
    heavy = join.heavy_keys(left, right, KEY, rows_a_task=100)
    assert [tuple(r) for r in heavy.collect()] == [(7, 0, 15, 0)]
    assert join.join_tables(left, right, KEY, heavy=heavy).df.count() == 3000
    assert join.join_tables(left, right, KEY, "inner", heavy=heavy).df.count() == 0


# ---- digits below the microsecond ----------------------------------------------------------------------------------


@pytest.fixture
def fine(spark, make):
    """Four moments, two of them 100 ns apart, a box and a missing one, after conversion."""
    from tallysheaf.plans.convert import convert
    from tallysheaf.plans.detect import detect_types

    texts = ["2025-01-01T00:00:00.0000011Z", "2025-01-01T00:00:00.000001200Z", "2025-01-01T01:00:00.000001100+01:00", "1969-12-31T23:59:59.999999999Z",
             "bald", "n/a", *["2025-01-01T00:00:00Z"] * 40]
    t = make("t string, i string, t__ns string", [(x, str(i), "own") for i, x in enumerate(texts)])
    return convert(t, detect_types(t).choose("i", "number").confirm())


def test_nanoseconds_stand_beside_a_column_that_is_called_so(fine):
    assert [(c.name, c.kind, c.raw, c.nanos) for c in fine.cols] == [
        ("t", "datetime", "t__raw", "t__ns_"), ("i", "number", None, None), ("t__ns", "text", None, None)]
    assert [r[-2] for r in fine.df.select("i", "t__ns_", "t").orderBy("i").collect()][:2] == [100, 200]


def test_moments_100_ns_apart_are_two(spark, fine):
    from pyspark.sql import functions as F

    from tallysheaf.functions.render import cell_text
    from tallysheaf.operators import aggregate, filter, profile, sort

    head = filter.filter_rows(fine, [{"column": "i", "op": "lt", "value": 6}])
    groups = aggregate.aggregate(head, ["t"], [{"op": "count"}])
    assert sorted(r["count"] for r in groups.df.collect()) == [1, 1, 1, 1, 2]
    ordered = sort.sort_rows(head, [{"column": "t"}]).ordered()
    assert [int(r.i) for r in ordered.collect()] == [3, 0, 2, 1, 4, 5]
    assert [int(r.i) for r in sort.sort_rows(head, [{"column": "t", "direction": "desc"}]).ordered().collect()] == [1, 0, 2, 3, 4, 5]
    at = "2025-01-01T00:00:00.0000011"
    kept = {op: sorted(int(r.i) for r in filter.filter_rows(head, [{"column": "t", "op": op, "value": at}]).df.collect()) for op in filter.OPERATORS[:6]}
    assert kept == {"eq": [0, 2], "ne": [1, 3], "lt": [3], "lte": [0, 2, 3], "gt": [1], "gte": [0, 1, 2]}
    ends = aggregate.aggregate(head, [], [{"op": o, "column": "t", "as": o} for o in ("minimum", "maximum", "count_distinct")])
    r = ends.df.first()
    assert (r[ends["minimum"].nanos], r[ends["maximum"].nanos], r["count_distinct"]) == (999, 200, 3)
    assert profile.column_profile(head, "s").where("column = 't'").first()["distinct_values"] == 3
    shown = [r[0] for r in head.df.orderBy("i").select(cell_text(head["t"])).collect()]
    assert shown[:5] == ["01.01.2025 00:00:00,0000011", "01.01.2025 00:00:00,0000012", "01.01.2025 00:00:00,0000011", "31.12.1969 23:59:59,999999999", "bald"]
    same = join.join_tables(head, groups, [{"left": "t", "right": "t"}], "inner")
    assert sorted((int(r.i), r["count"]) for r in same.df.collect()) == [(0, 2), (1, 1), (2, 2), (3, 1)]
    counts = join.join_counts(head, groups, [{"left": "t", "right": "t"}], "inner").first()
    assert (counts["rows_out"], counts["unmatched_left"]) == (4, 2)
    audit = join.duplicate_audit(head, head, [{"left": "t", "right": "t"}]).collect()
    assert [(r["t__ns"], r["rows_left"]) for r in audit] == [(100, 2)]
    assert F.lit(1) is not None


def test_nanoseconds_through_union_rename_and_files(spark, fine, tmp_path, make):
    import os

    from tallysheaf.operators.columns import select_columns
    from tallysheaf.operators.filter import filter_rows
    from tallysheaf.sources import sinks
    from tallysheaf.sources.parquet import read_parquet

    plain = make("u timestamp_ntz", []).with_df(spark.sql("SELECT TIMESTAMP_NTZ'2025-01-01 00:00:00.000001' AS u"), order=())
    head = select_columns(filter_rows(fine, [{"column": "i", "op": "lt", "value": 2}]), [{"from": "t", "to": "u"}])
    both = union.union_tables([head, plain])
    assert sorted(r[both["u"].nanos] for r in both.df.collect()) == [0, 100, 200]
    sinks.write_parquet(head, f"{tmp_path}/p")
    back = read_parquet(spark, f"{tmp_path}/p")[0]
    assert back.cols == head.cols and rows(back, True) == rows(head, True)
    sinks.write_json(head, f"{tmp_path}/j")
    lines = "".join(open(f"{tmp_path}/j/{f}").read() for f in sorted(os.listdir(f"{tmp_path}/j")) if f.endswith(".json")).split()
    assert lines == ['{"u":"2025-01-01T00:00:00.000001100"}', '{"u":"2025-01-01T00:00:00.000001200"}']


def test_a_column_called_like_a_companion_is_a_column(make, spark):
    from tallysheaf.operators.computed import add_computed
    from tallysheaf.table import Table

    t = Table.of(spark.createDataFrame([(1.0, "a", 0.0)], "x double, x__raw string, y double"))
    assert t.names == ["x", "x__raw", "y"] and t.hidden_names() == []
    out = add_computed(Table.of(t.df.withColumnRenamed("x__raw", "q__raw")), "q", "divide", ["x", "y"])
    assert out["q"].raw == "q__raw_" and out.df.first()["q__raw"] == "a"
