"""Headline timings on ``$BENCH_SF_DIR`` at ``local[$BENCH_CPUS]``: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallysheaf.operators import first, join, profile, search  # noqa: E402
from tallysheaf.operators.aggregate import aggregate  # noqa: E402
from tallysheaf.operators.filter import filter_rows  # noqa: E402
from tallysheaf.operators.sort import sort_rows  # noqa: E402
from tallysheaf.operators.union import union_tables  # noqa: E402
from tallysheaf.plans.convert import convert  # noqa: E402
from tallysheaf.plans.detect import detect_types  # noqa: E402
from tallysheaf.plans.recipe import FORMAT, run  # noqa: E402
from tallysheaf.plans.session import tune  # noqa: E402
from tallysheaf.sources import csv, sinks  # noqa: E402
from workload.inputs import report_text, table  # noqa: E402
from workload.queries import QUERIES, cond, key, pick  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def thirty_steps() -> dict:
    """Three order extracts unioned, joined, filtered, then twenty-four more steps."""
    steps = [{"id": "u", "kind": "union", "inputs": ["o1", "o2", "o3"]},
             {"id": "j", "kind": "join", "inputs": ["u", "c"], "config": {"keys": [key("o_custkey", "c_custkey")]}},
             {"id": "f", "kind": "filter", "inputs": "j",
              "config": {"combine": "all", "conditions": [cond("o_totalprice", "gt", 1000)]}}]
    last = "f"
    for i in range(8):
        for kind, config in (
            ("computed", {"name": f"n{i}", "op": "add", "inputs": ["o_totalprice", "c_acctbal"]}),
            ("filter", {"combine": "all", "conditions": [cond(f"n{i}", "gt", 1000 + i)]}),
            ("sort", {"keys": [{"column": f"n{i}", "direction": "desc"}]}),
        ):
            steps.append({"id": f"{kind}{i}", "kind": kind, "inputs": last, "config": config})
            last = f"{kind}{i}"
    steps += [
        {"id": "g", "kind": "aggregate", "inputs": last, "config": {
            "by": ["c_mktsegment"], "aggs": [{"op": "sum", "column": "n7", "as": "total"}, {"op": "count"}]}},
        {"id": "s", "kind": "sort", "inputs": "g", "config": {"keys": [{"column": "total"}]}},
        {"id": "r", "kind": "first", "inputs": "s", "config": {"count": 10}},
    ]
    return {"format": FORMAT, "name": "thirty", "sources": [{"id": i} for i in ("o1", "o2", "o3", "c")],
            "steps": steps, "result": "r"}


def cases(spark) -> dict:
    li, orders, cust = (table(spark, SF, n) for n in ("lineitem", "orders", "customer"))
    totals = aggregate(li, ["l_partkey", "l_suppkey"], [{"op": "sum", "column": "l_quantity", "as": "total"}])
    text = report_text(spark, SF)
    # Text as a text source delivers it: already in memory as text, split for all cores.
    rendered = text.df.repartition(int(CPUS)).cache()
    rendered.count()
    source = text.with_df(rendered)
    typing = detect_types(source).confirm()
    out = tempfile.mkdtemp(prefix="bench-")
    serial = iter(range(1000))
    lines = f"{out}/lines"
    sinks.write_csv(orders, lines)
    by_price = sort_rows(li, [{"column": "l_extendedprice", "direction": "desc"}])
    return {
        "filter": lambda: consume(filter_rows(li, [cond("l_quantity", "gt", 45)]).frame()),
        "left_join_one_key": lambda: consume(join.join_tables(orders, cust, [key("o_custkey", "c_custkey")]).frame()),
        "left_join_two_keys": lambda: consume(
            join.join_tables(li, totals, [key("l_partkey"), key("l_suppkey")]).frame()),
        "group_sum": lambda: consume(
            aggregate(li, ["l_returnflag"], [{"op": "sum", "column": "l_extendedprice", "as": "s"}]).frame()),
        "union_three": lambda: consume(union_tables([orders, orders, cust], [
            {"target": "k", "from": "o_custkey"}, {"target": "k", "from": "c_custkey"}]).frame()),
        "filter_join_group": lambda: consume(aggregate(
            join.join_tables(filter_rows(orders, [cond("o_totalprice", "gt", 1000)]), cust,
                             [key("o_custkey", "c_custkey")]),
            ["c_mktsegment"], [{"op": "sum", "column": "o_totalprice", "as": "s"}]).frame()),
        "sort_number": lambda: consume(by_price.ordered()),
        "sort_temporal": lambda: consume(sort_rows(li, [{"column": "l_shipdate"}]).ordered()),
        "sort_text_collated": lambda: consume(
            sort_rows(pick(table(spark, SF, "part"), "p_name", "p_partkey"), [{"column": "p_name"}]).ordered()),
        "first_thousand": lambda: consume(first.first_rows(by_price, 1000).frame()),
        "detect_types": lambda: detect_types(source),
        "convert": lambda: consume(convert(source, typing).frame(companions=True)),
        "search_documents": lambda: consume(search.search_counts(table(spark, SF, "documents"), "the")),
        "recipe_thirty_steps": lambda: consume(run(
            thirty_steps(), {"o1": orders, "o2": orders, "o3": orders, "c": cust}).table.frame()),
        "recipe_end_to_end": lambda: consume(QUERIES["recipe_end_to_end"](spark, SF)),
        "parquet_export": lambda: sinks.write_parquet(orders, f"{out}/p{next(serial)}"),
        "read_csv": lambda: consume(csv.read_csv(spark, lines).table.frame()),
        "recipe_report": lambda: run(thirty_steps(), {"o1": orders, "o2": orders, "o3": orders, "c": cust}).status(),
        "column_profile": lambda: consume(profile.column_profile(orders, "orders")),
        "csv_export": lambda: sinks.write_csv(orders, f"{out}/c{next(serial)}"),
    }


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    times = {}
    for name, work in cases(spark).items():
        work()  # the first run compiles and warms
        best = []
        for _ in range(2):
            start = time.perf_counter()
            work()
            best.append(time.perf_counter() - start)
        times[name] = round(min(best), 4)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": SF.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
