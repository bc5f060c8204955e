"""Match two tables on one or more key pairs, and report what the match did to the rows."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import report as R
from ..plans.storage import stored
from ..table import NANOS_SUFFIX, RAW_SUFFIX, Col, OrderKey, Table, col, named_order

TYPES = ("left", "inner")
_HIT = "__hit"


def default_config() -> dict:
    return {"keys": [], "type": "left", "nullsMatch": False, "duplicateAudit": False}


def validate(config) -> list[R.Diagnostic]:
    if not isinstance(config, dict):
        return [R.error(R.CONFIG_INVALID, field="config")]
    out = []
    keys = config.get("keys")
    if not isinstance(keys, list) or not keys:
        out.append(R.error(R.CONFIG_INVALID, field="keys"))
    else:
        for at, key in enumerate(keys):
            for side in ("left", "right"):
                name = key.get(side) if isinstance(key, dict) else None
                if not isinstance(name, str) or name == "":
                    out.append(R.error(R.CONFIG_INVALID, field=side, at=at))
    if config.get("type", "left") not in TYPES:
        out.append(R.error(R.CONFIG_INVALID, field="type", value=str(config.get("type"))))
    for flag in ("nullsMatch", "duplicateAudit"):
        if not isinstance(config.get(flag, False), bool):
            out.append(R.error(R.CONFIG_INVALID, field=flag, value=str(config.get(flag))))
    return out


def _check_keys(left: Table, right: Table, keys: list[dict]) -> None:
    faults = []
    for key in keys:
        missing = [(s, key[s]) for s, t in (("left", left), ("right", right)) if not t.has(key[s])]
        faults += [R.error(R.UNKNOWN_COLUMN, column=name, side=side) for side, name in missing]
        if not missing and left[key["left"]].kind != right[key["right"]].kind:
            faults.append(R.error(
                R.TYPE_MISMATCH, column=key["left"], columnType=left[key["left"]].kind,
                other=key["right"], valueType=right[key["right"]].kind,
            ))
    R.refuse_if(faults)


def _vacant(table: Table, names: list[str]) -> Column:
    """A key cell that is missing: NULL and not a box."""
    return reduce(or_, (col(n).isNull() & ~table[n].boxed for n in names))


def output_columns(left: Table, right: Table, keys: list[dict]) -> list[tuple[Col, str]]:
    """The right-hand columns a join adds, with their names in the result.

    A right key named like its left partner is dropped; any other clash gets ``_2``, ``_3``.
    """
    dropped = {k["right"] for k in keys if k["left"] == k["right"]}
    taken = set(left.names) | {c.name for c in right.cols if c.name not in dropped}
    used, out = set(left.names), []
    for c in right.cols:
        if c.name in dropped:
            continue
        name, n = c.name, 2
        while name in used:
            name = f"{c.name}_{n}"
            if name in taken and name not in used:
                used.add(name)
            n += 1
        used.add(name)
        out.append((c, name))
    return out


def join_tables(
    left: Table,
    right: Table,
    keys: list[dict],
    type: str = "left",
    nulls_match: bool = False,
    report: R.Report | None = None,
    heavy: DataFrame | None = None,
) -> Table:
    """Equi-join, left by default. Missing keys match nothing unless ``nulls_match``; a boxed key never matches.

    The condition is plain equality (or null-safe equality), so Catalyst picks broadcast, hash or sort-merge by
    measured size, and AQE splits a skewed key of the left side. With the :func:`heavy_keys` of the two tables, keys of
    many rows on either side are dealt to several tasks, and rows that can't match are led past the join.
    """
    R.refuse_if(validate({"keys": keys, "type": type, "nullsMatch": nulls_match}))
    _check_keys(left, right, keys)

    left_names, right_names = [k["left"] for k in keys], [k["right"] for k in keys]
    left_order, left_keys = named_order(left, "l")
    right_order, right_keys = named_order(right, "r")
    added = output_columns(left, right, keys)

    taken = {*left.names, *(name for _, name in added)}
    left_cols, right_cols, cols = [], [], []
    for side, pairs in ((left_cols, [(c, c.name) for c in left.cols]), (right_cols, added)):
        for c, name in pairs:
            cells, renamed = c.renamed(name, taken)
            side += cells
            cols.append(renamed)
    left_cols += [col(h).alias(f"__lk{i}{RAW_SUFFIX}") for i, l in enumerate(left_names) if nulls_match for h in [left[l].raw] if h]
    conditions = []
    for i, (l, r) in enumerate(zip(left_names, right_names)):
        right_cols.append(col(r).alias(f"__rk{i}"))
        if left[l].nanos or right[r].nanos:
            left_cols.append(left[l].below.alias(f"__ln{i}"))
            right_cols.append(right[r].below.alias(f"__rn{i}"))
            conditions.append(F.col(f"__ln{i}") == F.col(f"__rn{i}"))
        pair = (col(l), F.col(f"__rk{i}"))
        conditions.append(pair[0].eqNullSafe(pair[1]) if nulls_match else pair[0] == pair[1])
        if nulls_match:
            # NULL matches NULL here, and a box is NULL in its column: keep the boxes out.
            if left[l].raw:
                conditions.append(F.col(f"__lk{i}{RAW_SUFFIX}").isNull())
            if right[r].raw:
                right_cols.append(col(right[r].raw).alias(f"__rk{i}{RAW_SUFFIX}"))
                conditions.append(F.col(f"__rk{i}{RAW_SUFFIX}").isNull())

    left_side = left.df.select(*left_cols, *left_order)
    right_side = right.df.select(*right_cols, *right_order, F.lit(True).alias(_HIT))
    if heavy is None:
        joined = left_side.join(right_side, reduce(and_, conditions), type)
    else:
        pairs = [(col(l), F.col(f"__ln{i}") if f"__ln{i}" in left_side.columns else None) for i, l in enumerate(left_names)]
        others = [(F.col(f"__rk{i}"), F.col(f"__rn{i}") if f"__rn{i}" in right_side.columns else None) for i in range(len(keys))]
        joined = _dealt_join(left_side, right_side, pairs, others, conditions, type, nulls_match, heavy)
    if report is not None:
        report.close(left)
        report.close(right)
        both, counted = _both_counts(left, right, keys, type, nulls_match)
        seen = report.count(both, **counted)

        def counts():
            of = seen()
            found = [R.info(R.JOIN_UNMATCHED, rows=of["unmatched_left"])] if type == "left" else []
            if of["rows_out"] > of["rows_left"]:
                found.append(R.warning(R.JOIN_GROWTH, before=of["rows_left"], after=of["rows_out"],
                                       factor=of["rows_out"] / max(of["rows_left"], 1)))
            if of["null_keys_left"] and of["null_keys_right"]:
                found.append(R.warning(R.JOIN_NULL_KEYS, left=of["null_keys_left"], right=of["null_keys_right"]))
            return found

        report.later(counts)
    keep = [x for c in cols for x in (col(c.name), *map(col, c.hidden))]
    order = (*left_keys, *right_keys)
    df = joined.select(*keep, *[col(k.name) for k in order])
    return Table(df, tuple(cols), order if left.order and right.order else ())


def heavy_keys(left: Table, right: Table, keys: list[dict], nulls_match: bool = False, rows_a_task: int = 1_000_000) -> DataFrame:
    """The keys with more than ``rows_a_task`` rows on a side, from key counts alone: the key, and in how many pieces each
    side's rows are to be dealt (``right`` is 0 where the other side has none). Each stands for that many rows, so they
    are fewer than the rows divided by it. The counts are taken now."""
    _check_keys(left, right, keys)
    l, r = _key_counts(left, [k["left"] for k in keys], "l"), _key_counts(right, [k["right"] for k in keys], "r")
    l, r = l.where(~F.col("l_boxed")), r.where(~F.col("r_boxed"))
    if not nulls_match:
        l, r = l.where(~F.col("l_vacant")), r.where(~F.col("r_vacant"))
    same = [F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")) for i in range(len(keys)) for k in (f"k{i}", f"n{i}")]
    both = l.join(r, reduce(and_, same), "left")
    many = (F.col("l_n") > rows_a_task) | (F.col("r_n") > rows_a_task)
    pieces = [F.coalesce(F.ceil(F.col(f"{s}_n") / rows_a_task), F.lit(0)).cast("int").alias(side) for s, side in (("l", "left"), ("r", "right"))]
    return stored(both.where(many).select(*[F.col(f"l_{k}").alias(k) for i in range(len(keys)) for k in (f"k{i}", f"n{i}")], *pieces), "heavy-keys")


def _dealt_join(
    left: DataFrame, right: DataFrame, left_keys: list[tuple], right_keys: list[tuple], conditions: list[Column], type: str,
    nulls_match: bool, heavy: DataFrame,
) -> DataFrame:
    """The join in three: rows of heavy keys, dealt on a grid of pieces where each pair meets once; rows that match nothing,
    kept or dropped without moving; and all the rest."""

    def marked(side: DataFrame, keys: list[tuple]) -> DataFrame:
        same = [key.eqNullSafe(F.col(f"k{i}")) & (F.lit(0) if n is None else n).eqNullSafe(F.col(f"n{i}")) for i, (key, n) in enumerate(keys)]
        listed = heavy.withColumnsRenamed({"left": "__left", "right": "__right"})
        return side.join(F.broadcast(listed), reduce(and_, same), "left").select(*[col(c) for c in side.columns], "__left", "__right")

    here, there = marked(left, left_keys), marked(right, right_keys)
    vacant = F.lit(False) if nulls_match else reduce(or_, (key.isNull() for key, _ in left_keys))
    lone = vacant | F.coalesce(F.col("__right") == 0, F.lit(False))
    mine, theirs = [col(c) for c in left.columns], [col(c) for c in right.columns]
    # A row's own piece is settled before it is copied to the pieces of the other side.
    row = F.monotonically_increasing_id()
    dealt_left = here.where(F.col("__right") > 0).select(*mine, "__right", F.pmod(row, F.col("__left")).cast("int").alias("__row"))
    dealt_left = dealt_left.select(*mine, "__row", F.explode(F.sequence(F.lit(0), F.col("__right") - 1)).alias("__column"))
    dealt_right = there.where(F.col("__left") > 0).select(*theirs, "__left", F.pmod(row, F.col("__right")).cast("int").alias("__other_column"))
    dealt_right = dealt_right.select(*theirs, "__other_column", F.explode(F.sequence(F.lit(0), F.col("__left") - 1)).alias("__other_row"))
    met = [F.col("__row") == F.col("__other_row"), F.col("__column") == F.col("__other_column")]
    hot = dealt_left.join(dealt_right, reduce(and_, [*conditions, *met]), "inner").select(*mine, *theirs)
    rest = here.where(F.col("__left").isNull() & ~lone).select(*mine).join(
        there.where(F.col("__left").isNull()).select(*theirs), reduce(and_, conditions), type)
    joined = rest.unionByName(hot)
    return joined.unionByName(here.where(lone).select(*mine), allowMissingColumns=True) if type == "left" else joined


def join_counts(left: Table, right: Table, keys: list[dict], type: str = "left", nulls_match: bool = False) -> DataFrame:
    """The join's report as one row, from key frequencies alone: nothing is joined row by row.

    Columns: ``rows_left``, ``rows_out``, ``unmatched_left``, ``growth``, ``null_keys_left``, ``null_keys_right``.
    """
    both, counts = _both_counts(left, right, keys, type, nulls_match)
    rows, out = counts["rows_left"], counts["rows_out"]
    growth = F.try_divide(out, rows)
    return both.agg(*[c.alias(n) for n, c in counts.items()], growth.alias("growth")).select(
        "rows_left", "rows_out", "unmatched_left", "growth", "null_keys_left", "null_keys_right")


def _both_counts(left: Table, right: Table, keys: list[dict], type: str, nulls_match: bool) -> tuple[DataFrame, dict[str, Column]]:
    """Both sides' rows per key, side by side, and the aggregates over them that make the join's report."""
    _check_keys(left, right, keys)
    l, r = _key_counts(left, [k["left"] for k in keys], "l"), _key_counts(right, [k["right"] for k in keys], "r")
    matched = [
        F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")) if nulls_match else F.col(f"l_{k}") == F.col(f"r_{k}")
        for i in range(len(keys)) for k in (f"k{i}", f"n{i}")
    ]
    both = l.join(r, reduce(and_, [*matched, ~F.col("l_boxed"), ~F.col("r_boxed")]), "full")
    pairs = F.col("l_n") * F.col("r_n")
    alone = F.when(F.col("r_n").isNull(), F.col("l_n"))
    zero = F.lit(0).cast("bigint")
    out = F.coalesce(F.sum(pairs), zero)
    if type == "left":
        out = out + F.coalesce(F.sum(alone), zero)
    rows = F.coalesce(F.sum("l_n"), zero)
    return both, {
        "rows_left": rows, "rows_out": out, "unmatched_left": F.coalesce(F.sum(alone), zero),
        "null_keys_left": F.coalesce(F.sum(F.when(F.col("l_vacant"), F.col("l_n"))), zero),
        "null_keys_right": F.coalesce(F.sum(F.when(F.col("r_vacant"), F.col("r_n"))), zero),
    }


def _key_counts(table: Table, names: list[str], side: str) -> DataFrame:
    """Rows per key. Boxed keys are kept apart from missing ones; partial counts leave each task once per key."""
    boxed = reduce(or_, (table[n].boxed for n in names))
    keyed = table.df.select(
        *[x for i, n in enumerate(names) for x in (col(n).alias(f"{side}_k{i}"), table[n].below.alias(f"{side}_n{i}"))],
        boxed.alias(f"{side}_boxed"), _vacant(table, names).alias(f"{side}_vacant"),
    )
    return keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias(f"{side}_n"))


def duplicate_audit(left: Table, right: Table, keys: list[dict], nulls_match: bool = False) -> DataFrame:
    """Keys occurring more than once on a side: the key, its rows on each side and the rows it makes in the output. A key
    with digits below the microsecond on either side has them in a column beside it."""
    _check_keys(left, right, keys)
    names = [k["left"] for k in keys]
    l, r = _key_counts(left, names, "l"), _key_counts(right, [k["right"] for k in keys], "r")
    l, r = l.where(~F.col("l_boxed")), r.where(~F.col("r_boxed"))
    if not nulls_match:
        l, r = l.where(~F.col("l_vacant")), r.where(~F.col("r_vacant"))
    same = [F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")) for i in range(len(keys)) for k in (f"k{i}", f"n{i}")]
    fine = [left[k["left"]].nanos or right[k["right"]].nanos for k in keys]
    zero = F.lit(0).cast("bigint")
    both = l.join(r, reduce(and_, same), "full")
    left_n, right_n = F.coalesce("l_n", zero), F.coalesce("r_n", zero)
    return both.where((left_n > 1) | (right_n > 1)).select(
        *[F.coalesce(F.col(f"l_k{i}"), F.col(f"r_k{i}")).alias(n) for i, n in enumerate(names)],
        *[F.coalesce(F.col(f"l_n{i}"), F.col(f"r_n{i}")).alias(n + NANOS_SUFFIX) for i, n in enumerate(names) if fine[i]],
        left_n.alias("rows_left"), right_n.alias("rows_right"), (left_n * right_n).alias("rows_out"),
    )


def apply(inputs: list[Table], config: dict, report: R.Report | None = None) -> Table:
    left, right = inputs
    keys, nulls = config.get("keys", []), config.get("nullsMatch", False)
    out = join_tables(left, right, keys, config.get("type", "left"), nulls, report)
    if report is not None and config.get("duplicateAudit", False):
        audit = duplicate_audit(left, right, keys, nulls)

        def summary():
            row = audit.agg(
                R.count_if(F.col("rows_left") > 1).alias("left"), R.count_if(F.col("rows_right") > 1).alias("right"),
                F.coalesce(F.sum("rows_out"), F.lit(0)).alias("rows_out"),
            ).first()
            return [R.info(R.JOIN_AUDIT, left=row["left"], right=row["right"], rows_out=row["rows_out"])]

        report.later(summary)
    return out
