"""A minimal workbook writer for the workbook query and tests: inline strings, numbers, dates, booleans."""

from __future__ import annotations

import datetime
import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd

_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_DAY_ZERO = datetime.datetime(1899, 12, 30)


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, datetime.datetime):
        return f'<c s="1"><v>{(value - _DAY_ZERO).total_seconds() / 86400!r}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t>{escape(str(value))}</t></is></c>'


def book_bytes(sheets: dict[str, list[list]]) -> bytes:
    """The bytes of a workbook with these sheets of rows."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        entries = "".join(
            f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {_MAIN} xmlns:r="{_REL}"><sheets>{entries}</sheets></workbook>')
        targets = "".join(
            f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{targets}</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {_MAIN}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs>'
                                    "</styleSheet>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f"<row>{''.join(map(_cell, r))}</row>" for r in rows)
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {_MAIN}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def customer_book(pdf: pd.DataFrame) -> pd.DataFrame:
    """One group of at most a thousand customers as one workbook."""
    pdf = pdf.sort_values("c_custkey")
    rows = [["Nr", "Name", "Land", "Saldo", "Segment"]]
    columns = [pdf[c] for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")]
    rows += [[int(k), n, int(land), float(b), s] for k, n, land, b, s in zip(*columns)]
    return pd.DataFrame({"path": [f"customers-{int(pdf['book'].iloc[0])}.xlsx"],
                         "content": [book_bytes({"Kunden": rows})]})
