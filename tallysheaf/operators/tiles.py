"""The data of dashboard tiles: one grouping column, one measured column, one aggregation, one row limit."""

from __future__ import annotations

from ..table import Table
from .aggregate import aggregate
from .first import first_rows
from .sort import sort_rows

VALUE = "value"


def _measured(table: Table, group: str, op: str, measure: str | None) -> Table:
    return aggregate(table, [group], [{"op": op, "column": measure, "as": VALUE}])


def top_n(table: Table, group: str, op: str, measure: str | None, limit: int) -> Table:
    """The groups with the largest value; equal values stay in group order. Also the data of a bar chart."""
    ranked = sort_rows(_measured(table, group, op, measure), [{"column": VALUE, "direction": "desc"}])
    return first_rows(ranked, limit)


def bottom_n(table: Table, group: str, op: str, measure: str | None, limit: int) -> Table:
    """The groups with the smallest value."""
    ranked = sort_rows(_measured(table, group, op, measure), [{"column": VALUE}])
    return first_rows(ranked, limit)


bar = top_n


def line(table: Table, group: str, op: str, measure: str | None, limit: int) -> Table:
    """The values along the grouping column, in its order."""
    return first_rows(sort_rows(_measured(table, group, op, measure), [{"column": group}]), limit)


def key_figure(table: Table, op: str, measure: str | None = None) -> Table:
    """One number over the whole table."""
    return aggregate(table, [], [{"op": op, "column": measure, "as": VALUE}])
