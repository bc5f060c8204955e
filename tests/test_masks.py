"""Values counted by spelling: few of them, and each with its values' mask."""

from pyspark.sql import functions as F

from tallysheaf.plans import masks


def test_values_that_are_read_alike_are_one_spelling(spark):
    """Many values, few spellings, and each spelling has its value's mask."""
    numbers = [f"{i}.{i + 100},{i % 90 + 10}" for i in range(2, 10)] + ["0,5", "9007199254740991", "9007199254740992", "(1,5)", "-3 %", "€ 7"]
    moments = [f"1995-03-04T1{i}:20:3{i}.00000{i}{i}07+05:30" for i in range(2, 10)] + [
        "2000-02-29T24:00Z", "1900-02-29 10:00", "1995-03-04T10:20:30-00:00", "04.03.1995 25:00", "19950304T1020", "4 March 1995 9:05"]
    others = [f"note {i}: nothing" for i in range(8)] + ["29.02.1900", "29.02.2000", "31.04.95", "17:30", "123:59", "12:60", "ja", "0", "k.A.", "", "-01 x", "12 August 1995"]
    df = spark.createDataFrame([(v,) for v in numbers + moments + others], "v string")
    v = F.col("v")
    spelt = df.select(v.alias("of"), masks.spelling(v, (v >= "0") & (v < ":"), F.substring(v, 1, 1)).alias("v"))
    whole = {r.v: r.mask for r in masks.with_masks(df, ()).collect()}
    seen = {r.of: (r.v, r.mask) for r in masks.with_masks(spelt, ()).collect()}
    assert {k: m for k, (_, m) in seen.items()} == whole
    assert [len({seen[x][0] for x in group[:8]}) for group in (numbers, moments, others)] == [1, 1, 1]
    want: dict = {}
    for r in masks.with_masks(df).collect():
        want[r.mask] = want.get(r.mask, 0) + 1
    assert {r["mask"]: r["n"] for r in masks.mask_histogram(df, ["v"]).collect()} == want


def test_few_values_of_a_large_column_reach_the_masks(spark):
    """However many numbers and moments a column has, those counted together are few."""
    df = spark.range(0, 20000, 1, 2).select(
        F.format_number(F.col("id") * 997 % 99999 / 7 + 100000, 2).alias("n"),
        F.concat(F.lit("1995-03-04T10:20:30.1"), F.lpad(F.col("id").cast("string"), 8, "2"), F.lit("Z")).alias("at"))
    few = {r["at"]: r["count"] for r in masks._counted(df, ["n", "at"], ["-"], ()).groupBy("at").count().collect()}
    assert few[0] < 2000 and few[1] <= 2
