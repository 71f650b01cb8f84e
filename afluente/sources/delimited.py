"""Delimited files as a raw grid: one row per line, all cells text, no header.

Small files are read whole (many per task) and their lines are numbered by
position. Bigger files are split into blocks, one block per task, so a row's
number inside its task is its number inside the block. Both ways number the
lines without a shuffle, and in the same way on every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from afluente import constants as C
from afluente.functions.columns import computed
from afluente.functions.text import blank_to_null, decode_latin1, plain_path, split_cells
from afluente.session import block_size, one_block_per_task
from afluente.sources.folder import Folder, extension_rank, file_name, files, load_matching
from afluente.sources.listing import hidden_lines

# Files up to this size are read whole; it equals Spark's own cost of opening a file.
SMALL_FILE_BYTES = 4 << 20

_WHOLE_FILE = 1 << 50
_ROW_IN_TASK = (1 << 33) - 1
_BYTE_ORDER_MARK = "\xef\xbb\xbf"
_LINE_ENDS = "[\r\n]+"


def _text(content: Column) -> Column:
    """File content without the mark and line ends that enclose it."""
    text = decode_latin1(content)
    marked = text.startswith(_BYTE_ORDER_MARK)
    unmarked = F.when(marked, F.substr(text, F.lit(len(_BYTE_ORDER_MARK) + 1))).otherwise(text)
    return F.btrim(unmarked, F.lit("\r\n"))


def _small_files(folder: Folder, small_file_bytes: int) -> DataFrame | None:
    found = files(folder, C.DELIMITED_EXTENSIONS)
    return None if found is None else found.where(F.col("length") <= small_file_bytes)


def _big_file_lines(folder: Folder, small_file_bytes: int, bytes_per_block: int) -> DataFrame | None:
    """Non-blank lines of the big files as (uri, length, block, value)."""
    reader = one_block_per_task(folder.spark, bytes_per_block).read.format("text")
    columns = [
        F.col("_metadata.file_path").alias("uri"),
        F.col("_metadata.file_size").alias("length"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value"),
    ]
    found = load_matching(reader, folder, C.DELIMITED_EXTENSIONS, columns)
    return None if found is None else found.where((F.col("length") > small_file_bytes) & (F.col("value") != ""))


def delimited_lines(
    folder: Folder, small_file_bytes: int = SMALL_FILE_BYTES, bytes_per_block: int | None = None
) -> DataFrame | None:
    """Every non-blank line as (uri, block, line, value), in file order by (block, line)."""
    bytes_per_block = bytes_per_block or block_size(folder.spark)
    hidden = hidden_lines(folder, bytes_per_block)
    hidden = None if hidden is None else hidden.select("uri", "block", "line", "value")
    whole = _small_files(folder, small_file_bytes)
    blocks = _big_file_lines(folder, small_file_bytes, bytes_per_block)
    if whole is None or blocks is None:
        return hidden
    small = whole.select(
        "uri",
        F.lit(0).cast("bigint").alias("block"),
        F.posexplode(F.split(_text(F.col("content")), _LINE_ENDS, -1)).alias("line", "value"),
    ).where(F.col("value") != "")
    numbered = blocks.withColumn("line", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_IN_TASK)))
    big = numbered.select("uri", "block", "line", decode_latin1(F.col("value")))
    listed = small.withColumn("line", F.col("line").cast("bigint")).unionAll(big)
    return listed if hidden is None else listed.unionAll(hidden)


def delimited_grid(
    folder: Folder, small_file_bytes: int = SMALL_FILE_BYTES, bytes_per_block: int | None = None
) -> DataFrame | None:
    """(uri, sheet_no, block, line, cells) of all delimited files."""
    lines = delimited_lines(folder, small_file_bytes, bytes_per_block)
    return None if lines is None else lines.select(
        "uri",
        F.lit(0).alias("sheet_no"),
        "block",
        "line",
        split_cells(F.col("value"), folder.separator).alias("cells"),
    )


def delimited_widths(
    folder: Folder, small_file_bytes: int = SMALL_FILE_BYTES, bytes_per_block: int | None = None
) -> DataFrame | None:
    """(uri, sheet_no, width) of all delimited files: the cells of the widest line. Lines are scanned, not cut."""
    lines = delimited_lines(folder, small_file_bytes, bytes_per_block)
    if lines is None:
        return None
    without = F.replace("value", F.lit(folder.separator), F.lit(""))
    separators = (F.length("value") - F.length(without)) / F.lit(len(folder.separator))
    return lines.groupBy("uri").agg((F.max(separators) + 1).cast("int").alias("width")).withColumn("sheet_no", F.lit(0))


def _first_lines(head_rows: int):
    """Reader of the first lines of the single file in a task; the rest is never pulled from the scan."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, taken = [], 0
        for batch in batches:
            kept.append(batch.slice(0, head_rows - taken))
            taken += kept[-1].num_rows
            if taken == head_rows:
                break
        if taken:
            head = pa.Table.from_batches(kept)
            lines = pa.array([head["value"].to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [head["uri"].combine_chunks().slice(0, 1), head["length"].combine_chunks().slice(0, 1), lines],
                ["uri", "length", "lines"],
            )

    return read


def rectangular(df: DataFrame, rows: Column, least_width: Column | None = None) -> DataFrame:
    """``df`` with ``rows`` padded with null to the width of the widest row or ``least_width``; empty cells become null."""
    widest = F.array_max(F.transform("_rows", lambda r: F.size(r)))
    wide = computed(computed(df, _rows=rows), _width=widest if least_width is None else F.greatest(widest, least_width))

    def padded(row: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col("_width") - 1), lambda i: blank_to_null(F.get(row, i)))

    filled = F.when(F.size("_rows") > 0, F.transform("_rows", padded)).otherwise(F.col("_rows"))
    return computed(wide, rows=filled).drop("_rows", "_width")


def delimited_heads(
    folder: Folder, small_file_bytes: int = SMALL_FILE_BYTES, head_rows: int = C.HEAD_ROWS
) -> DataFrame | None:
    """First lines of each file: (uri, path, file, rank, sheet, sheet_no, length, rows, error)."""
    found = _listed_heads(folder, small_file_bytes, head_rows)
    hidden = hidden_lines(folder, _WHOLE_FILE, head_rows)
    if hidden is not None:
        first = F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda r: r["value"])
        hidden = hidden.groupBy("uri", "length").agg(first.alias("lines"))
        found = hidden if found is None else found.unionAll(hidden)
    if found is None:
        return None
    path = plain_path(F.col("uri"))
    name = file_name(path)
    cells = F.transform("lines", lambda line: split_cells(line, folder.separator))
    return rectangular(found, cells).select(
        "uri",
        path.alias("path"),
        name.alias("file"),
        extension_rank(name).alias("rank"),
        F.lit(None).cast("string").alias("sheet"),
        F.lit(0).alias("sheet_no"),
        "length",
        "rows",
        F.lit(None).cast("string").alias("error"),
    )


def _listed_heads(folder: Folder, small_file_bytes: int, head_rows: int) -> DataFrame | None:
    """(uri, length, lines) of the first lines of the files that Spark's readers list."""
    whole = _small_files(folder, small_file_bytes)
    blocks = _big_file_lines(folder, small_file_bytes, _WHOLE_FILE)
    if whole is None or blocks is None:
        return None
    lines = F.split(_text(F.col("content")), _LINE_ENDS, head_rows + 1)
    visible = F.filter(F.slice(lines, 1, head_rows), lambda v: v != "")
    small = whole.select("uri", "length", visible.alias("lines"))
    # One task per big file: it stops after the first batch instead of reading the file.
    big = blocks.select("uri", "length", decode_latin1(F.col("value")).alias("value")).mapInArrow(
        _first_lines(head_rows), "uri string, length bigint, lines array<string>"
    )
    return small.unionAll(big)
