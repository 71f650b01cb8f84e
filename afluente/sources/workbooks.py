"""Workbooks (.xlsx) as a raw grid, one task handling a few workbooks at a time.

Spark has no reader for this format, so each workbook is opened inside a task
with the standard library; Spark spreads the workbooks and does the rest.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afluente import constants as C
from afluente.functions.text import plain_path
from afluente.sources.delimited import rectangular
from afluente.sources.folder import Folder, extension_rank, file_name, files

SHEETS_SCHEMA = "uri string, length bigint, sheet string, sheet_no int, error string"
ROWS_SCHEMA = "uri string, sheet_no int, line bigint, cells array<string>"
HEADS_SCHEMA = "uri string, length bigint, sheet string, sheet_no int, rows array<array<string>>, width int, error string"

_ROWS_PER_BATCH = 4096
_XML = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats of the file format that show a date or a time.
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet, in tab order."""
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    parts = {link.get("Id"): posixpath.normpath(posixpath.join("/xl", link.get("Target")))[1:] for link in links}
    tree = ElementTree.fromstring(book.read("xl/workbook.xml"))
    return [(s.get("name"), parts.get(s.get(_RELATION), "")) for s in tree.iter(f"{_XML}sheet")]


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as part:
        return [_joined_text(item) for item in _elements(part, "sst", "si")]


def _elements(part, parent: str, child: str) -> Iterator[ElementTree.Element]:
    """Each ``child`` in turn; the parent is emptied as it grows, so memory stays flat."""
    holder = None
    for event, node in ElementTree.iterparse(part, ("start", "end")):
        if event == "start" and node.tag == f"{_XML}{parent}":
            holder = node
        elif event == "end" and node.tag == f"{_XML}{child}" and holder is not None:
            yield node
            holder.clear()


def _joined_text(node: ElementTree.Element) -> str:
    """Text of a string item: its own and that of its runs, without phonetic hints."""
    runs = [node, *node.findall(f"{_XML}r")]
    return "".join(t.text or "" for run in runs for t in run.findall(f"{_XML}t"))


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles that show their number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    tree = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in tree.iter(f"{_XML}numFmt")}

    def is_date(format_id: int) -> bool:
        if format_id not in own:
            return format_id in _DATE_FORMATS
        outside_quotes = "".join(own[format_id].split('"')[::2]).lower()
        return any(c in outside_quotes.split("]")[-1] for c in "dmyhs")

    cells = tree.find(f"{_XML}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else ()) if is_date(int(x.get("numFmtId", 0)))}


def _column(reference: str) -> int:
    number = 0
    for c in reference:
        if not c.isalpha():
            break
        number = number * 26 + ord(c.upper()) - 64
    return number - 1


def _number_text(text: str, as_date: bool, base: datetime) -> str:
    number = float(text)
    if as_date:
        moment = base + timedelta(seconds=round(number * 86400))
        return moment.strftime("%Y-%m-%d") if number == int(number) else moment.strftime("%Y-%m-%d %H:%M:%S")
    return str(int(number)) if number == int(number) and abs(number) < 2**63 else repr(number)


def sheet_rows(book: zipfile.ZipFile, part: str, strings: list[str], dates: set[int], base: datetime) -> Iterator[list]:
    """Non-blank rows of a sheet as lists of text or None."""
    with book.open(part) as sheet:
        for row in _elements(sheet, "sheetData", "row"):
            cells: list[str | None] = []
            for cell in row.findall(f"{_XML}c"):
                at = _column(cell.get("r")) if cell.get("r") else len(cells)
                cells.extend([None] * (at + 1 - len(cells)))
                kind, value = cell.get("t", "n"), cell.findtext(f"{_XML}v")
                if kind == "inlineStr":
                    inline = cell.find(f"{_XML}is")
                    value = _joined_text(inline) if inline is not None else None
                elif value is None:
                    continue
                elif kind == "s":
                    value = strings[int(value)]
                elif kind == "b":
                    value = "true" if value == "1" else "false"
                elif kind == "n":
                    value = _number_text(value, int(cell.get("s", 0)) in dates, base)
                elif kind == "e":
                    value = None
                cells[at] = value or None
            if any(c is not None for c in cells):
                yield cells


def common_parts(book: zipfile.ZipFile) -> tuple[list[str], set[int], datetime]:
    """What all sheets of a book need: its shared strings, the styles of dates and the day that dates count from."""
    properties = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_XML}workbookPr")
    late = properties is not None and properties.get("date1904") in ("1", "true")
    return _shared_strings(book), _date_styles(book), datetime(1904, 1, 1) if late else datetime(1899, 12, 30)


def _open_rows(content: bytes) -> Iterator[tuple[int, str, Iterator[list]]]:
    """(number, name, rows) of each sheet of one workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        common = common_parts(book)
        for number, (name, part) in enumerate(sheet_parts(book)):
            yield number, name, sheet_rows(book, part, *common)


def _workbooks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    for batch in batches:
        for uri, length, content in zip(batch["uri"], batch["length"], batch["content"]):
            yield uri.as_py(), length.as_py(), content.as_py()


def _as_batch(rows: list[tuple], fields: list[pa.Field]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))


_TEXTS = pa.list_(pa.string())
_SHEET_FIELDS = [
    pa.field("uri", pa.string()),
    pa.field("length", pa.int64()),
    pa.field("sheet", pa.string()),
    pa.field("sheet_no", pa.int32()),
]
_ERROR = pa.field("error", pa.string())


def _list_sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for uri, length, content in _workbooks(batches):
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as book:
                found = [(uri, length, name, number, None) for number, (name, _) in enumerate(sheet_parts(book))]
        except Exception as error:  # an unreadable workbook is reported, and the run goes on
            found = [(uri, length, None, 0, f"{type(error).__name__}: {error}")]
        if found:
            yield _as_batch(found, [*_SHEET_FIELDS, _ERROR])


def _whole_sheet(rows: Iterator[list], head_rows: int) -> tuple[list, int, str | None]:
    """First rows, width and fault of a sheet, which is read to its end to know them."""
    head, width = [], 0
    try:
        for row in rows:
            width = max(width, len(row))
            if len(head) < head_rows:
                head.append(row)
    except Exception as error:  # this sheet is reported, its neighbours are read
        return [], 0, f"{type(error).__name__}: {error}"
    return head, width, None


def _heads_reader(head_rows: int, include: frozenset[str] | None, exclude: frozenset[str]):
    fields = [*_SHEET_FIELDS, pa.field("rows", pa.list_(_TEXTS)), pa.field("width", pa.int32()), _ERROR]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri, length, content in _workbooks(batches):
            found = []
            try:
                for number, name, rows in _open_rows(content):
                    if _wanted(name, include, exclude):
                        found.append((uri, length, name, number, *_whole_sheet(rows, head_rows)))
            except Exception as error:  # what all sheets share cannot be read
                found = [(uri, length, None, 0, [], 0, f"{type(error).__name__}: {error}")]
            if found:
                yield _as_batch(found, fields)

    return read


def _wanted(sheet: str, include: frozenset[str] | None, exclude: frozenset[str]) -> bool:
    return sheet not in exclude and (include is None or sheet in include)


def _reader(include: frozenset[str] | None, exclude: frozenset[str]):
    fields = [
        pa.field("uri", pa.string()),
        pa.field("sheet_no", pa.int32()),
        pa.field("line", pa.int64()),
        pa.field("cells", _TEXTS),
    ]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple] = []
        for uri, _, content in _workbooks(batches):
            for number, rows in _sheets_to_read(content, include, exclude):
                for line, cells in _until_fault(rows):
                    pending.append((uri, number, line, cells))
                    if len(pending) == _ROWS_PER_BATCH:
                        yield _as_batch(pending, fields)
                        pending = []
        if pending:
            yield _as_batch(pending, fields)

    return read


def _sheets_to_read(
    content: bytes, include: frozenset[str] | None, exclude: frozenset[str]
) -> Iterator[tuple[int, Iterator[list]]]:
    """(number, rows) of the wanted sheets; none of a book that cannot be opened, as its head reports."""
    try:
        for number, name, rows in _open_rows(content):
            if _wanted(name, include, exclude):
                yield number, rows
    except Exception:
        return


def _until_fault(rows: Iterator[list]) -> Iterator[tuple[int, list]]:
    """Numbered rows up to the first fault.

    The head of the sheet was read to the end and has met the same fault, so the sheet is
    an error in the layout, and none of the rows let out here finds a source to join.
    """
    try:
        yield from enumerate(rows)
    except Exception:
        return


def workbook_files(folder: Folder) -> DataFrame | None:
    return files(folder, C.WORKBOOK_EXTENSIONS)


def list_sheets(workbooks: DataFrame) -> DataFrame:
    """(path, file, sheet, sheet_no, error) from workbooks given as (uri, length, content)."""
    found = workbooks.select("uri", "length", "content").mapInArrow(_list_sheets, SHEETS_SCHEMA)
    path = plain_path(F.col("uri"))
    return found.select(path.alias("path"), file_name(path).alias("file"), "sheet", "sheet_no", "error")


def workbook_heads(
    workbooks: DataFrame,
    include: frozenset[str] | None = None,
    exclude: frozenset[str] = frozenset(),
    head_rows: int = C.HEAD_ROWS,
) -> DataFrame:
    """First rows of every wanted sheet, as wide as the whole sheet, in the form that delimited files have too.

    A sheet with a fault anywhere has no rows and an error; other sheets of its book are not touched.
    """
    read = _heads_reader(head_rows, include, exclude)
    found = workbooks.select("uri", "length", "content").mapInArrow(read, HEADS_SCHEMA)
    found = rectangular(found.withColumnRenamed("rows", "ragged"), F.col("ragged"), F.col("width"))
    path = plain_path(F.col("uri"))
    name = file_name(path)
    return found.select(
        "uri",
        path.alias("path"),
        name.alias("file"),
        extension_rank(name).alias("rank"),
        "sheet",
        "sheet_no",
        "length",
        "rows",
        "error",
    )


def workbook_grid(
    workbooks: DataFrame, include: frozenset[str] | None = None, exclude: frozenset[str] = frozenset()
) -> DataFrame:
    """(uri, sheet_no, block, line, cells) of the wanted sheets of all workbooks.

    A faulty sheet gives its rows up to the fault; only its head says so, so join the grid with a layout.
    """
    found = workbooks.select("uri", "length", "content").mapInArrow(_reader(include, exclude), ROWS_SCHEMA)
    return found.select("uri", "sheet_no", F.lit(0).cast("bigint").alias("block"), "line", "cells")


def _ship_by_value() -> None:
    """Send the readers with the job, so executors need no copy of this package."""
    import sys

    for module in (sys.modules[__name__], sys.modules["afluente.sources.delimited"], C):
        cloudpickle.register_pickle_by_value(module)


_ship_by_value()
