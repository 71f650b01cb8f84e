"""First data rows of the sources of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afluente import constants as C
from afluente.operators.headers import detect_layout, positional_rename
from afluente.plans.layout import source_heads
from afluente.sources.delimited import SMALL_FILE_BYTES
from afluente.sources.folder import Folder, narrowed
from afluente.sources.sheets import SheetRule


def preview_rows(layout: DataFrame, rows: int = C.PREVIEW_ROWS) -> DataFrame:
    """(path, sheet, line, cells) below the header of every source, as far as its layout holds rows."""
    body = F.slice("rows", F.col("header_line") + 2, F.lit(rows))
    return layout.where(F.col("status") == "ok").select("path", "sheet", F.posexplode(body).alias("line", "cells"))


def preview(
    folder: Folder, path: str, sheet: str | None = None, rows: int = C.PREVIEW_ROWS, small_file_bytes: int = SMALL_FILE_BYTES
) -> DataFrame | None:
    """The first ``rows`` rows of one source under its column names; None for a source without any.

    Only that file is listed and opened, and of a workbook only that sheet, up to the last row shown. The header is among
    the first lines that a layout samples, so that many lines more are taken.
    """
    sheets = SheetRule() if sheet is None else SheetRule("include", {sheet})
    try:
        heads = source_heads(narrowed(folder, [path]), sheets, small_file_bytes, C.HEAD_ROWS + rows, first_rows_only=True)
    except FileNotFoundError:
        return None
    source = detect_layout(heads.where((F.col("path") == path) & F.col("sheet").eqNullSafe(F.lit(sheet))))
    found = source.where(F.col("status") == "ok").select("names").first()
    if found is None:
        return None
    return preview_rows(source, rows).orderBy("line").select(*positional_rename(F.col("cells"), found["names"]))
