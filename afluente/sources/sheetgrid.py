"""Sheets of workbooks as a Spark data source: one input partition per sheet, each sheet parsed once.

Tasks list the sheets of every book from the end of its file, and a sheet's task reads the parts that it needs
and nothing else of the book. The rows are saved in the shared folder, where the layout and every
run find them. Stores that only Spark's readers know keep the reader of whole books.
"""

from __future__ import annotations

import sys
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from afluente import constants as C
from afluente.functions.text import plain_path
from afluente.session import removed_path, shared_folder
from afluente.sources import stores, workbooks
from afluente.sources.delimited import rectangular
from afluente.sources.folder import Folder, extension_rank, file_name, files, location_of
from afluente.sources.listing import hidden_files
from afluente.sources.sheets import SheetRule, apply_sheet_rule

FORMAT = "afluente_sheets"
INVENTORY_SCHEMA = "uri string, length bigint, sheet string, sheet_no int, part string, bytes bigint, error string"
GRID_SCHEMA = "uri string, sheet_no int, line bigint, cells array<string>, error string"
# The most bytes of sheets, unpacked, that share a task; a bigger sheet has a task of its own.
SHARE_BYTES = 64 << 20

_ROWS_PER_BATCH = 4096
_INVENTORY_FIELDS = pa.schema(
    [("uri", pa.string()), ("length", pa.int64()), ("sheet", pa.string()), ("sheet_no", pa.int32()), ("part", pa.string()),
     ("bytes", pa.int64()), ("error", pa.string())]
)
_GRID_FIELDS = pa.schema(
    [("uri", pa.string()), ("sheet_no", pa.int32()), ("line", pa.int64()), ("cells", pa.list_(pa.string())), ("error", pa.string())]
)


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _list_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for uri, length in zip(batch["uri"].to_pylist(), batch["length"].to_pylist()):
            try:
                with stores.opened(uri) as source, zipfile.ZipFile(source) as book:
                    sizes = {i.filename: i.file_size for i in book.infolist()}
                    found += [(uri, length, n, k, part, sizes.get(part, 0), None) for k, (n, part) in enumerate(workbooks.sheet_parts(book))]
            except Exception as error:  # an unreadable workbook is reported, and the run goes on
                found.append((uri, length, None, 0, None, 0, f"{type(error).__name__}: {error}"))
        if found:
            yield _columns(found, _INVENTORY_FIELDS)


@dataclass
class Sheets(InputPartition):
    """Sheets that one task parses, as (uri, number, part)."""

    wanted: list[tuple[str, int, str]]


class SheetReader(DataSourceReader):
    """Reads the sheets that a saved inventory lists."""

    def __init__(self, options) -> None:
        self.inventory = options["inventory"]
        self.cores = int(options["cores"])
        self.share = int(options.get("share", SHARE_BYTES))
        self.rows = int(options["rows"]) if "rows" in options else None

    def partitions(self) -> list[Sheets]:
        """One partition per sheet; where there are far more sheets than cores, neighbours share one up to ``share`` bytes."""
        store, place = stores.store_of(self.inventory)
        table = ds.dataset(place, filesystem=store, format="parquet", schema=_INVENTORY_FIELDS).to_table(
            ["uri", "sheet_no", "part", "bytes"], filter=ds.field("error").is_null()
        )
        listed = sorted(zip(*(table[c].to_pylist() for c in ("uri", "sheet_no", "part", "bytes"))))
        share = min(self.share, sum(s[3] for s in listed) // (8 * self.cores))
        found, held = [], share + 1
        for uri, number, part, size in listed:
            if held + size > share:
                found.append(Sheets([]))
                held = 0
            found[-1].wanted.append((uri, number, part))
            held += size
        return found

    def read(self, partition: Sheets | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there are no partitions
            return
        pending: list[tuple] = []
        for row in self._rows(partition):
            pending.append(row)
            if len(pending) == _ROWS_PER_BATCH:
                yield _columns(pending, _GRID_FIELDS)
                pending = []
        if pending:
            yield _columns(pending, _GRID_FIELDS)

    def _rows(self, partition: Sheets) -> Iterator[tuple]:
        """Rows of each sheet; a fault ends its sheet with a row that holds the error in place of cells."""
        for uri, sheets in groupby(partition.wanted, key=lambda s: s[0]):
            sheets = list(sheets)
            try:
                with stores.opened(uri) as source, zipfile.ZipFile(source) as book:
                    common = workbooks.common_parts(book)
                    for _, number, part in sheets:
                        yield from self._sheet(uri, number, workbooks.sheet_rows(book, part, *common))
            except Exception as error:  # what all sheets share cannot be read
                for _, number, _ in sheets:
                    yield uri, number, -1, None, f"{type(error).__name__}: {error}"

    def _sheet(self, uri: str, number: int, rows: Iterator[list]) -> Iterator[tuple]:
        try:
            for line, cells in enumerate(rows):
                if self.rows is not None and line >= self.rows:
                    return
                yield uri, number, line, cells, None
        except Exception as error:  # this sheet is reported, its neighbours are read
            yield uri, number, -1, None, f"{type(error).__name__}: {error}"


class SheetSource(DataSource):
    """The rows of all sheets in the inventory that the option ``inventory`` names."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return GRID_SCHEMA

    def reader(self, schema) -> SheetReader:
        return SheetReader(self.options)


def sheet_inventory(folder: Folder) -> DataFrame | None:
    """One row per sheet of the folder's workbooks, or per workbook that cannot be opened; None without workbooks."""
    found, hidden = files(folder, C.WORKBOOK_EXTENSIONS), hidden_files(folder, C.WORKBOOK_EXTENSIONS)
    found = None if found is None else found.where(F.col("length") > 0).select("uri", "length")
    if hidden is not None:
        hidden = hidden.repartition(folder.spark.sparkContext.defaultParallelism, "uri")
        found = hidden if found is None else found.unionAll(hidden)
    return None if found is None else found.mapInArrow(_list_parts, INVENTORY_SCHEMA)


def _registered(spark: SparkSession) -> str:
    """The name of the source in this session. Names are checked against whichever session is active, so each has its own."""
    own = f"{FORMAT}_{spark._jsparkSession.sessionUUID().replace('-', '')}"
    spark.dataSource.register(type("SheetSource", (SheetSource,), {"name": classmethod(lambda cls: own)}))
    return own


def read_sheets(spark: SparkSession, inventory: str, rows: int | None = None, share: int = SHARE_BYTES) -> DataFrame:
    """(uri, sheet_no, line, cells, error) of the sheets in a saved inventory; of each the first ``rows``, if given."""
    reader = spark.read.format(_registered(spark)).option("inventory", inventory).option("share", str(share))
    reader = reader.option("cores", str(spark.sparkContext.defaultParallelism))
    return (reader if rows is None else reader.option("rows", str(rows))).load()


@dataclass(frozen=True)
class SheetTables:
    """The inventory of a folder's wanted sheets and the rows of these sheets, saved at ``paths``."""

    inventory: DataFrame
    grid: DataFrame
    paths: tuple[str, ...]


def sheet_tables(folder: Folder, sheets: SheetRule = SheetRule(), rows: int | None = None) -> SheetTables | None:
    """The wanted sheets, parsed at the first call and found again by all later ones on the same folder.

    None if the folder has no workbooks, or lies in a store that tasks cannot open by themselves.
    """
    key = ("sheets", sheets.mode if sheets.names else "", frozenset(sheets.names), rows)
    if key not in folder.saved:
        folder.saved[key] = _saved_sheets(folder, sheets, rows)
    return folder.saved[key]


def _saved_sheets(folder: Folder, sheets: SheetRule, rows: int | None) -> SheetTables | None:
    spark = folder.spark
    place = shared_folder(spark)
    if not stores.reachable(location_of(folder), place):
        return None
    found = sheet_inventory(folder)
    if found is None:
        return None
    listed, parsed = f"{place}/inventory", f"{place}/rows"
    apply_sheet_rule(found.where(F.col("sheet").isNotNull() | F.col("error").isNotNull()), sheets).write.parquet(listed)
    read_sheets(spark, listed, rows).write.parquet(parsed)
    return SheetTables(
        spark.read.schema(INVENTORY_SCHEMA).parquet(listed), spark.read.schema(GRID_SCHEMA).parquet(parsed), (place,)
    )


def sheet_heads(tables: SheetTables, head_rows: int = C.HEAD_ROWS) -> DataFrame:
    """First rows of every sheet, as wide as the whole sheet, in the form that delimited files have too.

    A sheet with a fault anywhere has no rows and an error. Of each sheet only its first rows, its width and its error
    leave the tasks that read its rows.
    """
    head = F.when((F.col("line") >= 0) & (F.col("line") < head_rows), F.struct("line", "cells"))
    parsed = tables.grid.groupBy("uri", "sheet_no").agg(
        F.transform(F.array_sort(F.collect_list(head)), lambda r: r["cells"]).alias("ragged"),
        F.max(F.size("cells")).alias("width"),
        F.max("error").alias("fault"),
    )
    found = tables.inventory.join(parsed, ["uri", "sheet_no"], "left")
    error = F.coalesce("error", "fault")
    none = F.array().cast("array<array<string>>")
    ragged = F.when(error.isNotNull() | F.col("ragged").isNull(), none).otherwise(F.col("ragged"))
    found = rectangular(found.select("uri", "length", "sheet", "sheet_no", error.alias("error"), "width", ragged.alias("ragged")), F.col("ragged"), F.col("width"))
    path = plain_path(F.col("uri"))
    name = file_name(path)
    return found.select(
        "uri", path.alias("path"), name.alias("file"), extension_rank(name).alias("rank"), "sheet", "sheet_no", "length", "rows", "error"
    )


def sheet_grid(tables: SheetTables) -> DataFrame:
    """(uri, sheet_no, block, line, cells) of all wanted sheets; a faulty one gives its rows up to the fault."""
    return tables.grid.where(F.col("line") >= 0).select("uri", "sheet_no", F.lit(0).cast("bigint").alias("block"), "line", "cells")


def forget(folder: Folder) -> None:
    """Remove what was saved for the folder; nothing that was read from it can be used any more."""
    for found in folder.saved.values():
        for place in found.paths if found is not None else ():
            removed_path(folder.spark, place)
    folder.saved.clear()


for _module in (sys.modules[__name__], stores):
    cloudpickle.register_pickle_by_value(_module)
