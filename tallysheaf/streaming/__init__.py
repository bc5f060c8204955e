"""Row-wise steps over a stream.

Filter, columns, computed columns and conversion look at one row at a time, so they accept a streaming frame as it is;
steps that need a whole table (sort, first, union, join, aggregate) are refused here.
"""

from __future__ import annotations

from .. import report as R
from ..operators import columns, computed, filter
from ..table import Table

ROW_WISE = {"filter": filter, "columns": columns, "computed": computed}


def apply_row_wise(table: Table, steps: list[dict]) -> Table:
    """Apply ``[{"kind", "config"}]`` to a table over ``spark.readStream``; write its frame with ``writeStream``."""
    R.refuse_if([R.error(R.KIND_NOT_EXECUTABLE, kind=s["kind"]) for s in steps if s["kind"] not in ROW_WISE])
    for s in steps:
        R.refuse_if(ROW_WISE[s["kind"]].validate(s["config"]))
        table = ROW_WISE[s["kind"]].apply([table], s["config"])
    return table
