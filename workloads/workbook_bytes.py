"""A minimal workbook writer for fixtures."""

import io
import zipfile
from xml.sax.saxutils import escape

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _cell(value, column, row):
    reference = f'r="{chr(65 + column)}{row}"'
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c {reference} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c {reference}><v>{value}</v></c>"
    if isinstance(value, tuple):  # (serial number of a day,)
        return f'<c {reference} s="1"><v>{value[0]}</v></c>'
    return f'<c {reference} t="inlineStr"><is><t>{escape(value)}</t></is></c>'


def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        tabs = "".join(
            f'<sheet name="{escape(name)}" sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate(sheets, 1)
        )
        book.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{REL}"><sheets>{tabs}</sheets></workbook>')
        links = "".join(
            f'<Relationship Id="rId{i}" Type="t" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)
        )
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        book.writestr(
            "xl/styles.xml", f'<styleSheet {NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
        )
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(
                f'<row r="{r}">' + "".join(_cell(v, c, r) for c, v in enumerate(row)) + "</row>"
                for r, row in enumerate(rows, 1)
            )
            book.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def damaged(content: bytes) -> bytes:
    """The book with a number that is none in the first row below the header of its first sheet."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for name in old.namelist():
            part = old.read(name)
            if name == "xl/worksheets/sheet1.xml":
                part = part.replace(b'<c r="A2"><v>', b'<c r="A2"><v>x', 1)
            new.writestr(name, part)
    return out.getvalue()
