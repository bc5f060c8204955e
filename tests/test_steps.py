import pytest
from support import rows

from tallysheaf import report as R
from tallysheaf.operators import columns, filter, first, sort

AMOUNTS = [("Ahorn", 1000.0, "2025-12-31"), ("Birke", 500.0, "2024-12-31"), ("Äpfel", 1000.0, "2026-03-01"),
           ("Zeder", 250.0, "2025-06-15")]


@pytest.fixture
def amounts(make):
    from pyspark.sql import functions as F

    t = make("Kunde string, Betrag double, Datum string", AMOUNTS)
    df = t.df.withColumn("Datum", F.to_date("Datum"))
    from tallysheaf.table import Table

    return Table.of(df).with_df(df, order=t.order)


@pytest.fixture
def boxed(make):
    return make("v double, v__raw string, w string",
                [(9.0, None, "a"), (None, "ungefähr", "b"), (None, None, "c"), (3.0, None, "d"), (5.0, None, "e")])


def codes(refusal):
    return [d.code for d in refusal.value.diagnostics]


def cond(column, op, *value):
    return {"column": column, "op": op, **({"value": value[0]} if value else {})}


def test_config_refusals_are_all_reported():
    found = filter.validate({"combine": "xor", "conditions": [cond("", "eq", 1), cond("a", "like", 1), cond("a", "empty", 1)]})
    assert [d.values["field"] for d in found] == ["combine", "column", "op", "value"]
    assert [d.code for d in columns.validate({"columns": [{"from": "a"}, {"from": "b", "to": "a"}]})] == [R.RENAME_COLLISION]
    assert [d.code for d in sort.validate({"keys": [{"column": "a"}, {"column": "a"}]})] == [R.SORT_KEY_REPEATED]
    for bad in (0, -1, 1.5, True, "3"):
        assert first.validate({"count": bad})


def test_filter_compares_typed_values(amounts):
    keep = lambda *c, how="all": [r[0] for r in rows(filter.filter_rows(amounts, list(c), how))]
    assert keep(cond("Betrag", "gte", 1000)) == ["Ahorn", "Äpfel"]
    assert keep(cond("Datum", "lt", "2025-12-31")) == ["Birke", "Zeder"]
    assert keep(cond("Betrag", "lt", 400), cond("Kunde", "contains", "hor"), how="any") == ["Ahorn", "Zeder"]
    assert keep() == [r[0] for r in AMOUNTS]


def test_filter_refuses_before_running(amounts):
    with pytest.raises(R.Refused) as refusal:
        filter.filter_rows(amounts, [cond("Datum", "eq", 5), cond("Nix", "eq", 1), cond("Betrag", "eq", "1.000")])
    assert codes(refusal) == [R.TYPE_MISMATCH, R.UNKNOWN_COLUMN, R.TYPE_MISMATCH]
    for value in ("2025-02-30", "31.12.2025", "2025-1-1"):
        with pytest.raises(R.Refused) as refusal:
            filter.filter_rows(amounts, [cond("Datum", "eq", value)])
        assert codes(refusal) == [R.VALUE_UNREADABLE]


def test_empty_and_not_empty_are_complements(make):
    t = make("n string", [(None,), ("",), ("   ",), ("  ",), ("x",)])
    assert len(rows(filter.filter_rows(t, [cond("n", "empty")]))) == 4
    assert rows(filter.filter_rows(t, [cond("n", "not_empty")])) == [("x",)]


def test_a_box_matches_nothing_and_is_counted(boxed):
    report = R.Report()
    t = filter.filter_rows(boxed, [cond("v", "ne", 9)], report=report)
    assert [r[0] for r in rows(t)] == [3.0, 5.0]
    assert [(d.code, d.values) for d in report.diagnostics()] == [
        (R.ROWS_REMOVED, {"removed": 3, "kept": 2}), (R.BOXED_ROWS_DROPPED, {"rows": 1})]
    assert [r[2] for r in rows(filter.filter_rows(boxed, [cond("v", "empty")]), True)] == ["c"]
    both = filter.filter_rows(boxed, [cond("v", "lt", 4), cond("w", "eq", "b")], "any")
    assert [r[1] for r in rows(both)] == ["b", "d"]


def test_columns_rename_reorder_and_carry_boxes(boxed):
    t = columns.select_columns(boxed, [{"from": "w"}, {"from": "v", "to": "Wert"}, {"from": "v", "to": "nochmal"}])
    assert t.names == ["w", "Wert", "nochmal"]
    assert rows(t, True)[1] == ("b", None, "ungefähr", None, "ungefähr")
    with pytest.raises(R.Refused) as refusal:
        columns.select_columns(boxed, [{"from": "x"}, {"from": "y"}])
    assert codes(refusal) == [R.UNKNOWN_COLUMN] * 2
    assert columns.select_columns(boxed, []) is boxed


def test_sort_puts_empty_and_boxed_last_in_both_directions(boxed):
    for direction, head in (("asc", ["d", "e", "a"]), ("desc", ["a", "e", "d"])):
        report = R.Report()
        t = sort.sort_rows(boxed, [{"column": "v", "direction": direction}], report)
        assert [r[1] for r in rows(t)] == [*head, "b", "c"]
        assert [d.values for d in report.diagnostics()] == [{"rows": 1}]


def test_sort_is_stable_refines_and_collates(make):
    t = make("g string, n int", [("b", 1), ("a", 2), ("b", 3), ("a", 4)])
    assert [r[1] for r in rows(sort.sort_rows(t, [{"column": "g"}]))] == [2, 4, 1, 3]
    refined = sort.sort_rows(sort.sort_rows(t, [{"column": "n", "direction": "desc"}]), [{"column": "g"}])
    assert [r[1] for r in rows(refined)] == [4, 2, 3, 1]
    words = ["Zebra", "Straße", "Osten", "Äpfel", "apfel", "Öl", "Apfel", "Strasse"]
    t = make("w string", [(w,) for w in words])
    assert [r[0] for r in rows(sort.sort_rows(t, [{"column": "w"}]))] == [
        "apfel", "Apfel", "Äpfel", "Öl", "Osten", "Strasse", "Straße", "Zebra"]


def test_first_and_last_keep_forward_order(boxed):
    ordered = sort.sort_rows(boxed, [{"column": "v"}])
    assert [r[1] for r in rows(first.first_rows(ordered, 2))] == ["d", "e"]
    report = R.Report()
    last = first.first_rows(ordered, 2, "last", report)
    assert [r[1] for r in rows(last)] == ["b", "c"]
    assert [(d.code, d.values) for d in report.diagnostics()] == [
        (R.ROWS_REMOVED, {"removed": 3, "kept": 2}), (R.BOXED_ROWS_KEPT, {"rows": 1})]
    assert len(rows(first.first_rows(boxed, 99))) == 5
    assert first.first_rows(boxed, None) is boxed


def test_an_order_survives_renames_and_drops(boxed):
    t = sort.sort_rows(boxed, [{"column": "v", "direction": "desc"}])
    t = columns.select_columns(t, [{"from": "w", "to": "k"}])
    assert [r[0] for r in rows(first.first_rows(t, 3))] == ["a", "e", "d"]
