"""Own sample rows with the edge shapes of retail lines, and a minimal workbook writer."""

from __future__ import annotations

import datetime as dt
import zipfile
from xml.sax.saxutils import escape

from tallyline.schemas import RAW_ROWS, SHEET_HEADER

DAY = dt.datetime(2023, 3, 15, 14, 5)
FILE, SHEET = "sha256:sample", "Lines"


def line(invoice, code, quantity, price=1.75, when=DAY):
    return [invoice, code, f"about {code}", quantity, when, price, "SOMEONE", "Somewhere"]


# Two orders with a numeric product code, a whole row that repeats, a zero and a return; then, from row 50 on,
# every invoice text there can be: no, one or mixed white space around a prefixed, lower-case, other or empty
# stem, next to an absent and a logical one.
CELLS = {
    31: line(880, "TEA", 4),
    32: line(880, 6001, 9),
    34: line(881, "CUP", 3),
    37: line(881, "POT", 12),
    38: line(880, "TEA", 4),
    41: line(882, "NONE-SOLD", 0),
    75: line("C883", "BACK", -5, 8.5),
}
AROUND = [("", ""), ("  ", " "), ("\t", "\n ")]
STEMS = ["C5", "c5", "X5", ""]
INVOICES = [before + stem + after for before, after in AROUND for stem in STEMS if before + stem + after] + [None, False]
CELLS |= {50 + i: line(invoice, f"M{i}", 1) for i, invoice in enumerate(INVOICES)}


def expected_marker(invoice, kind):
    """The marker rule once more, on the value itself."""
    stem = invoice.strip(" \t\r\n") if invoice is not None and kind in ("text", "integer") else ""
    return "unknown" if not stem else str(stem[0] in "Cc").lower()


def _text(value):
    return None if value is None else str(value)


def _kind(value):
    if value is None:
        return "missing"
    if isinstance(value, bool):
        return "unsupported"
    return "text" if isinstance(value, str) else "integer"


def raw(spark, numbers, cells=CELLS, file=FILE, loaded=DAY):
    rows = [
        (file, SHEET, n, _text(c[0]), _kind(c[0]), _text(c[1]), c[2], _text(c[3]), _text(c[4]), _text(c[5]), c[6], c[7], loaded)
        for n, c in ((n, cells[n]) for n in numbers)
    ]
    return spark.createDataFrame(rows, RAW_ROWS)


def selection(spark, numbers, file=FILE):
    return spark.createDataFrame(
        [(file, SHEET, n) for n in numbers], "source_file_id string, sheet_name string, source_row_number bigint"
    )


def _cell(ref, value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, dt.datetime):
        serial = (value - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)
        return f'<c r="{ref}" s="1"><v>{serial!r}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'


def write_workbook(path, numbers, cells=CELLS, header=SHEET_HEADER, sheet=SHEET):
    rows = {1: list(header), **{n: cells[n] for n in numbers}}
    body = "".join(
        f'<row r="{n}">' + "".join(_cell(f"{'ABCDEFGH'[i]}{n}", v) for i, v in enumerate(values)) + "</row>"
        for n, values in sorted(rows.items())
    )
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rels = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{main}" xmlns:r="{rels}"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Type="worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        book.writestr(
            "xl/styles.xml",
            f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>',
        )
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return path
