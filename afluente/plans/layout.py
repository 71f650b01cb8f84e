"""The layout of a folder: one row per file or sheet, worked out once and saved."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from afluente import constants as C
from afluente.functions.text import blank_to_null, plain_path
from afluente.operators.combine import origin_text
from afluente.operators.headers import detect_layout, widened
from afluente.operators.mapping import final_columns, join_mapping
from afluente.session import BROADCAST_LIMIT_BYTES, block_size, written
from afluente.sources.delimited import SMALL_FILE_BYTES, delimited_grid, delimited_heads, delimited_widths
from afluente.sources.folder import Folder, extension_rank, file_name
from afluente.sources.listing import unread_files
from afluente.sources.sheetgrid import sheet_grid, sheet_heads, sheet_tables
from afluente.sources.sheets import SheetRule, apply_sheet_rule, reconcile_sheets
from afluente.sources.workbooks import workbook_files, workbook_grid, workbook_heads

# Position of a row among all sources; together these are unique.
ROW_ORDER = ("__rank", "__path", "__sheet_no", "__block", "__line")


def source_heads(
    folder: Folder,
    sheets: SheetRule = SheetRule(),
    small_file_bytes: int = SMALL_FILE_BYTES,
    head_rows: int = C.HEAD_ROWS,
    first_rows_only: bool = False,
) -> DataFrame:
    """First rows of every file and wanted sheet of the folder; files that no reader opens have none.

    With ``first_rows_only`` sheets are not read beyond them; their width and faults are then those of the first rows.
    """
    books = _book_heads(folder, sheets, head_rows, first_rows_only)
    found = [delimited_heads(folder, small_file_bytes, head_rows), books, _unread_heads(folder)]
    return _all_of(folder, found)


def _book_heads(folder: Folder, sheets: SheetRule, head_rows: int, first_rows_only: bool) -> DataFrame | None:
    tables = sheet_tables(folder, sheets, head_rows if first_rows_only else None)
    if tables is not None:
        return sheet_heads(tables, head_rows)
    books = workbook_files(folder)
    return None if books is None else workbook_heads(books, *_sheet_names(sheets), head_rows)


def _book_grid(folder: Folder, sheets: SheetRule) -> DataFrame | None:
    tables = sheet_tables(folder, sheets)
    if tables is not None:
        return sheet_grid(tables)
    books = workbook_files(folder)
    return None if books is None else workbook_grid(books, *_sheet_names(sheets))


def _unread_heads(folder: Folder) -> DataFrame | None:
    """Heads without rows for the files that are not read, so that the audit knows them."""
    odd = unread_files(folder)
    if odd.isEmpty():
        return None
    path = plain_path(F.col("uri"))
    name = file_name(path)
    return odd.select(
        "uri",
        path.alias("path"),
        name.alias("file"),
        extension_rank(name).alias("rank"),
        F.lit(None).cast("string").alias("sheet"),
        F.lit(0).alias("sheet_no"),
        "length",
        F.array().cast("array<array<string>>").alias("rows"),
        F.col("detail").alias("error"),
    )


def _sheet_names(sheets: SheetRule) -> tuple[frozenset[str] | None, frozenset[str]]:
    """Names to include (None: all) and names to exclude."""
    names = frozenset(sheets.names)
    return (names if names and sheets.mode == "include" else None, names if sheets.mode == "exclude" else frozenset())


def source_grid(
    folder: Folder, sheets: SheetRule, small_file_bytes: int = SMALL_FILE_BYTES, bytes_per_block: int | None = None
) -> DataFrame:
    """All rows of every file and wanted sheet of the folder."""
    return _all_of(folder, [delimited_grid(folder, small_file_bytes, bytes_per_block), _book_grid(folder, sheets)])


def _all_of(folder: Folder, found: list[DataFrame | None]) -> DataFrame:
    frames = [frame for frame in found if frame is not None]
    if not frames:
        raise FileNotFoundError(f"no supported file in {folder.location}")
    return reduce(DataFrame.unionByName, frames)


def read_layout(
    folder: Folder,
    sheets: SheetRule = SheetRule(),
    choices: DataFrame | None = None,
    small_file_bytes: int = SMALL_FILE_BYTES,
    to_the_end: bool = True,
) -> DataFrame:
    """Header row, column names, status and sample of each source, saved in the shared folder.

    Each source has as many columns as its widest row. For text files that takes a scan of all lines; without
    ``to_the_end`` their width is that of the first lines.
    """
    heads = source_heads(folder, sheets, small_file_bytes)
    if choices is not None:
        heads = reconcile_sheets(heads, choices, sheets)
    else:
        heads = apply_sheet_rule(heads, sheets)
    layout = written(detect_layout(heads))
    if not to_the_end:
        return layout
    total = layout.where(F.col("status") == "ok").agg(F.sum("length")).first()[0] or 0
    widths = delimited_widths(folder, small_file_bytes, bytes_per_block(folder, total))
    return layout if widths is None else widen_layout(layout, widths)


def widen_layout(layout: DataFrame, widths: DataFrame) -> DataFrame:
    """The layout, saved again, with all columns of the widest rows in ``widths`` (uri, sheet_no, width)."""
    return written(widened(layout, widths))


@dataclass(frozen=True)
class FinalColumn:
    """A column of the result; ``copies`` is the most source columns it has in one source."""

    name: str
    type: str
    copies: int


@dataclass(frozen=True)
class Projection:
    """How each source maps to the final columns."""

    sources: DataFrame
    columns: tuple[FinalColumn, ...]
    lookup_bytes: int
    source_bytes: int


def project_layout(layout: DataFrame, mapping: DataFrame | None) -> Projection:
    """Join the layout with a mapping; without one, all columns keep their names as text."""
    columns = layout.where(F.col("status") == "ok").select(
        "path", "sheet", "sheet_no", F.posexplode("names").alias("column_no", "column")
    )
    matched = columns.withColumn("final_name", F.col("column")) if mapping is None else join_mapping(columns, mapping)
    entries = matched.groupBy("path", "sheet_no").agg(
        F.array_sort(F.collect_list(F.struct("column_no", "final_name"))).alias("entries")
    )
    sources = written(
        layout.select(
            "uri", "path", "sheet_no", "rank", "header_line", "length", "status", "error", F.size("names").alias("width"),
            origin_text(F.col("file"), F.col("sheet")).alias("origin"),
        ).join(entries, ["path", "sheet_no"], "left")
    )

    per_source = (
        sources.select("rank", "path", "sheet_no", F.inline("entries"))
        .groupBy("rank", "path", "sheet_no", "final_name")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("column_no").alias("column_no"))
    )
    found = per_source.groupBy("final_name").agg(
        F.max("copies").alias("copies"), F.min(F.struct("rank", "path", "sheet_no", "column_no")).alias("first")
    )
    if mapping is None:
        found = found.withColumn("type", F.lit(C.TYPE_TEXT))
    else:
        found = found.join(final_columns(mapping), "final_name")
    # The result's own schema: it has to be known here, and has one row per final column.
    schema = found.select("final_name", "type", "copies", "first").collect()
    final = tuple(
        FinalColumn(row.final_name, row.type, row.copies) for row in sorted(schema, key=lambda row: row["first"])
    )
    cells = sum(c.copies for c in final)
    size = F.sum(F.length("uri") + F.length("path") + F.length("origin") + F.lit(8 * (cells + 16)))
    totals = sources.where(F.col("entries").isNotNull()).agg(size.alias("lookup"), F.sum("length").alias("read")).first()
    return Projection(sources, final, totals["lookup"] or 0, totals["read"] or 0)


def bytes_per_block(folder: Folder, source_bytes: int) -> int:
    """Split size of this run: small enough to occupy all cores, and fixed from here on."""
    share = source_bytes // (2 * folder.spark.sparkContext.defaultParallelism)
    return min(block_size(folder.spark), max(SMALL_FILE_BYTES, share))


def rows_below_headers(
    folder: Folder,
    layout: DataFrame,
    sheets: SheetRule = SheetRule(),
    small_file_bytes: int = SMALL_FILE_BYTES,
    sample_rows: int | None = None,
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """(uri, sheet_no, cells) of all sources with a header; of each no more than its first ``sample_rows``, if given."""
    lookup = layout.where(F.col("status") == "ok").select("uri", "sheet_no", "length", "header_line")
    totals = lookup.agg(F.sum(F.length("uri") + 64).alias("lookup"), F.sum("length").alias("read")).first()
    grid = source_grid(folder, sheets, small_file_bytes, bytes_per_block(folder, totals["read"] or 0))
    rows = join_sources(grid, lookup, totals["lookup"] or 0, broadcast_limit)
    if sample_rows is not None:
        rows = rows.where((F.col("block") == 0) & (F.col("line") <= F.col("header_line") + sample_rows))
    return rows.select("uri", "sheet_no", "cells")


def position_name(column: int, copy: int) -> str:
    return f"__at_{column}_{copy}"


def _lookup(projection: Projection) -> DataFrame:
    """One narrow row per source with the cell position of each final column."""

    def position(name: str, copy: int) -> Column:
        mine = F.filter("entries", lambda e: e["final_name"] == name)
        return F.get(mine, F.lit(copy))["column_no"]

    return projection.sources.where(F.col("entries").isNotNull()).select(
        "uri",
        "path",
        "sheet_no",
        "rank",
        "origin",
        "header_line",
        "length",
        "width",
        *[
            position(column.name, copy).alias(position_name(i, copy))
            for i, column in enumerate(projection.columns)
            for copy in range(column.copies)
        ],
    )


def join_layout(grid: DataFrame, projection: Projection, broadcast_limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Grid rows with the lookup row of their source, without the rows up to the header.

    The lookup is broadcast while its measured size allows. Beyond that, rows
    meet it by source and stretch of the file, so that a file which holds a
    large share of all rows is spread over as many tasks as it has stretches.
    """
    return join_sources(grid, _lookup(projection), projection.lookup_bytes, broadcast_limit)


def join_sources(grid: DataFrame, lookup: DataFrame, lookup_bytes: int, broadcast_limit: int) -> DataFrame:
    """Grid rows below the header with the row of their source in ``lookup``."""
    if lookup_bytes <= broadcast_limit:
        joined = grid.join(F.broadcast(lookup), ["uri", "sheet_no"])
    else:
        stretch = block_size(grid.sparkSession)
        last = F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / stretch)
        spread = lookup.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        cut = grid.withColumn("stretch", F.floor(F.col("block") / stretch))
        joined = cut.join(spread, ["uri", "sheet_no", "stretch"])
    return joined.where(~((F.col("block") == 0) & (F.col("line") <= F.col("header_line"))))


def mapped_cells(projection: Projection) -> list[Column]:
    """Final columns as text, taken from ``cells`` by the positions of the row's source."""

    def cell(column: int, copy: int) -> Column:
        return blank_to_null(F.get("cells", F.col(position_name(column, copy))))

    return [
        F.coalesce(*[cell(i, copy) for copy in range(column.copies)]).alias(column.name)
        for i, column in enumerate(projection.columns)
    ]


def present_columns(projection: Projection) -> dict[str, Column]:
    """Whether the row's source has each final column."""
    return {c.name: F.col(position_name(i, 0)).isNotNull() for i, c in enumerate(projection.columns)}


def audit_sources(projection: Projection, origin: str = C.ORIGIN, listed: DataFrame | None = None) -> DataFrame:
    """What became of each source: processed, empty, skipped, unmatched or error; and whether its own origin column gave way.

    With the files ``listed`` now (path, length), sources of an older layout are ``stale`` where their file has changed
    its length, and ``gone`` where it is no longer there.
    """
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("entries").isNull(), "unmatched").otherwise("processed")
    replaced = F.exists("entries", lambda e: e["final_name"] == origin)
    detail = F.coalesce("error", F.when(replaced, F.lit(C.ORIGIN_REPLACED)))
    sources = projection.sources
    if listed is not None:
        sources = sources.join(listed.select("path", F.col("length").alias("_now")), "path", "left")
        status = F.when(F.col("_now").isNull(), "gone").when(F.col("_now") != F.col("length"), "stale").otherwise(status)
    return sources.select("origin", "path", "sheet_no", status.alias("status"), detail.alias("detail"))
