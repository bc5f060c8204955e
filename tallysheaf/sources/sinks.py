"""Writing results out: one file per task, so a result of any size leaves through all executors at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.render import render_de
from ..table import BOX_OF, DATE, DATETIME, NANOS_OF, Col, Table, col

BOM = "\ufeff"


def _fine(c: Col):
    """A datetime with its nine fraction digits."""
    return F.concat(F.date_format(col(c.name), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lpad(col(c.nanos).cast("string"), 3, "0"))


def _scalar(c: Col):
    # JSON has no dates: they are written as the text they would be written as in a column without boxes.
    cell = col(c.name)
    if c.kind == DATETIME:
        return (_fine(c) if c.nanos else F.date_format(cell, "yyyy-MM-dd'T'HH:mm:ss.SSS")).cast("variant")
    return (cell.cast("string") if c.kind == DATE else cell).cast("variant")


def _json_cell(c: Col):
    if c.raw:
        return F.coalesce(col(c.raw).cast("variant"), _scalar(c))
    return _fine(c) if c.nanos else col(c.name)


def _in_order(table: Table) -> Table:
    return table.with_df(table.df.orderBy(*[k.asc() for k in table.order]) if table.order else table.df)


def write_csv(table: Table, path: str, delimiter: str = ";", bom: bool = True, mode: str = "errorifexists") -> None:
    """UTF-8 with a byte-order mark, German numbers and dates, boxes as their own text, columns and rows in order.

    Rows are range-sorted across the part files; read in name order they are the table's order.
    """
    df = render_de(_in_order(table)).frame()
    if bom and table.cols:
        # The mark opens every part file, as the first character of its header line.
        df = df.withColumnRenamed(table.names[0], BOM + table.names[0])
    (df.write.mode(mode).option("header", True).option("sep", delimiter).option("escape", '"')
       .option("quoteAll", False).option("emptyValue", "").option("encoding", "UTF-8")
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_json(table: Table, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line with typed values; in a column with boxes each box is its text."""
    df = _in_order(table).df.select(*[_json_cell(c).alias(c.name) for c in table.cols])
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_parquet(table: Table, path: str, mode: str = "errorifexists") -> None:
    """Columns with their kinds as field metadata and their companions beside them: ``read_back`` restores both."""
    exprs = []
    for c in table.cols:
        metadata = {"sheaf.kind": c.kind}
        if c.affix:
            metadata["sheaf.affix"] = c.affix
        exprs.append(col(c.name).alias(c.name, metadata=metadata))
        exprs += [col(h).alias(h, metadata={of: c.name}) for h, of in ((c.raw, BOX_OF), (c.nanos, NANOS_OF)) if h]
    _in_order(table).df.select(*exprs).write.mode(mode).parquet(path)
