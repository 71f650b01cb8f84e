"""Header analysis of a folder: layout, fingerprints and suggested groups."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afluente.functions.text import plain_path

from afluente.operators.mapping import build_mapping, default_settings
from afluente.operators.profile import column_counts, fingerprints_of, group_headers, widest_rows
from afluente.plans.publish import Store
from afluente.plans.layout import read_layout, rows_below_headers, widen_layout
from afluente.session import written
from afluente.sources.delimited import SMALL_FILE_BYTES
from afluente.sources.folder import Folder, narrowed
from afluente.sources.listing import folder_files
from afluente.sources.sheets import SheetRule


_CURRENT = "current.json"


@dataclass(frozen=True)
class Analysis:
    """``members`` and ``settings`` are what a user edits before ``mapping`` is built."""

    layout: DataFrame
    fingerprints: DataFrame
    members: DataFrame
    settings: DataFrame

    def mapping(self) -> DataFrame:
        return build_mapping(self.members, self.settings)


def analyze_headers(
    folder: Folder,
    sheets: SheetRule = SheetRule(),
    choices: DataFrame | None = None,
    small_file_bytes: int = SMALL_FILE_BYTES,
    sample_rows: int | None = None,
) -> Analysis:
    """Headers, types and suggested groups. Types are those of all rows, or of ``sample_rows`` per source at most.

    Columns are always those of the widest row; where all rows are profiled, that pass finds them.
    """
    layout, counts = _scanned(folder, sheets, choices, small_file_bytes, sample_rows)
    return _analysis(layout, counts)


def _scanned(
    folder: Folder, sheets: SheetRule, choices: DataFrame | None, small_file_bytes: int, sample_rows: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Layout and column counts of the folder's sources; both saved."""
    layout = read_layout(folder, sheets, choices, small_file_bytes, to_the_end=sample_rows is not None)
    if layout.where("status = 'ok'").isEmpty():
        rows = folder.spark.createDataFrame([], "uri string, sheet_no int, cells array<string>")
    else:
        rows = rows_below_headers(folder, layout, sheets, small_file_bytes, sample_rows)
    counts = column_counts(rows)
    return (widen_layout(layout, widest_rows(counts)) if sample_rows is None else layout), counts


def _analysis(layout: DataFrame, counts: DataFrame) -> Analysis:
    fingerprints = written(fingerprints_of(counts, layout))
    members = group_headers(fingerprints)
    return Analysis(layout, fingerprints, members, default_settings(members))


@dataclass(frozen=True)
class Refresh:
    """An analysis, and the ``files`` (path, change) that made it differ from the one before: new, changed or gone."""

    analysis: Analysis
    files: DataFrame


def refresh_headers(folder: Folder, place: str, sheets: SheetRule = SheetRule(), small_file_bytes: int = SMALL_FILE_BYTES) -> Refresh:
    """The analysis of the folder, kept at ``place``; only files that are new or changed since are read.

    ``place`` holds a version of the layout and of the column counts, with the path, length and modification time of every
    file. Files that vanished leave. A new version is complete before it becomes the current one, so a run that fails
    leaves the version before. Other sheet rules than those of the kept version start anew. The paths of changed files pass
    through the driver, as they do in any list of files to read.
    """
    spark = folder.spark
    store, place = Store(spark, place), place.rstrip("/")
    rule = f"{sheets.mode if sheets.names else ''}:{sorted(sheets.names)}:{folder.separator}"
    current = store.read(f"{place}/{_CURRENT}")
    version = json.loads(current) if current else {}
    known = version.get("folder") if version.get("rule") == rule else None
    listed = written(folder_files(folder))
    before = spark.read.parquet(f"{known}/files") if known else listed.limit(0)
    old, new = before.select("path", F.struct("length", "modified").alias("old")), listed.select("path", F.struct("length", "modified").alias("new"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").otherwise("changed")
    differ = old.join(new, "path", "full").where(~F.col("old").eqNullSafe(F.col("new")))
    files = written(differ.select("path", change.alias("change")))
    touched = [r["path"] for r in files.where("change <> 'gone'").collect()]  # the files to read
    if known and files.isEmpty():
        return Refresh(_analysis(*[spark.read.parquet(f"{known}/{part}") for part in ("layout", "counts")]), files)
    tables = _scanned(narrowed(folder, touched) if known else folder, sheets, None, small_file_bytes) if touched or not known else None
    target = f"{place}/v-{uuid.uuid4().hex}"
    for position, part in enumerate(("layout", "counts")):
        fresh = tables[position] if tables else None
        if known:
            kept = spark.read.parquet(f"{known}/{part}")
            of_file = plain_path(F.col("uri"))
            kept = kept.join(files.select(F.col("path").alias("_path")), of_file == F.col("_path"), "left_anti")
            fresh = kept if fresh is None else kept.unionByName(fresh)
        fresh.write.parquet(f"{target}/{part}")
    listed.write.parquet(f"{target}/files")
    store.replace(f"{place}/{_CURRENT}", json.dumps({"folder": target, "rule": rule}))
    if version.get("folder"):
        store.remove(version["folder"])
    return Refresh(_analysis(*[spark.read.parquet(f"{target}/{part}") for part in ("layout", "counts")]), files)
