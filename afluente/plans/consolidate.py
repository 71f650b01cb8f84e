"""Whole runs: from a folder or from tables to the consolidated result."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from afluente import constants as C
from afluente.functions.casts import SPARK_TYPES, lenient_cast, typed_text
from afluente.functions.text import named
from afluente.functions.types import common_type
from afluente.operators.combine import (
    DuplicateRule,
    add_origin,
    column_last,
    harmonize,
    keep_first,
    removed_duplicates,
    union_frames,
)
from afluente.operators.filters import CompiledFilter, FilterRule, IgnoredRule, compile_filter
from afluente.operators.mapping import map_columns
from afluente.operators.outputs import chunk_rows, sanitize_text, write_csv, write_parquet
from afluente.operators.summary import SummaryRule, summary_table
from afluente.plans.publish import RunReport, publish
from afluente.plans.layout import (
    ROW_ORDER,
    audit_sources,
    bytes_per_block,
    join_layout,
    mapped_cells,
    present_columns,
    project_layout,
    read_layout,
    source_grid,
)
from afluente.session import BROADCAST_LIMIT_BYTES, removed_path, shared_folder
from afluente.sources.delimited import SMALL_FILE_BYTES
from afluente.sources.folder import Folder
from afluente.sources.listing import folder_files
from afluente.sources.sheets import SheetRule

NO_DUPLICATE_RULE = DuplicateRule()
NO_SUMMARY = SummaryRule()


@dataclass(frozen=True)
class Outputs:
    """Lazy results of a run; what is absent is None.

    ``accounting`` has one row per source with the rows read below its header, those with more cells
    than the source has columns, those that the filters left, those removed as duplicates, and those
    in the result. ``base`` holds the typed rows that everything else comes from.
    """

    ordered: DataFrame
    order: tuple[str, ...]
    consolidated: DataFrame
    removed: DataFrame | None
    summary: DataFrame | None
    summary_rule: SummaryRule
    audit: DataFrame | None = None
    ignored_rules: tuple[IgnoredRule, ...] = field(default=())
    accounting: DataFrame | None = None
    removed_ordered: DataFrame | None = None
    base: DataFrame | None = None
    rebuild: Callable[[DataFrame], Outputs] | None = None

    def removed_chunks(self, rows_per_chunk: int = C.ROWS_PER_SHEET) -> DataFrame | None:
        """The removed rows with the name of the sheet-sized block each belongs to."""
        if self.removed is None:
            return None
        cut = chunk_rows(self.removed_ordered, self.order, rows_per_chunk, C.SHEET_REMOVED)
        return cut.select(*[named(c) for c in [*self.removed.columns, "chunk"]])

    def chunks(self, rows_per_chunk: int = C.ROWS_PER_SHEET) -> DataFrame:
        """The consolidated rows with the name of the sheet-sized block each belongs to."""
        visible = [*self.consolidated.columns, "chunk"]
        return chunk_rows(self.ordered, self.order, rows_per_chunk).select(*[named(c) for c in visible])


# Marks of a base row: whether the filters keep it, whether it has more cells than columns.
_KEPT, _WIDE = "__kept", "__wide"


def _finish(
    base: DataFrame,
    order: Sequence[str],
    duplicates: DuplicateRule,
    summary: SummaryRule,
    audit: DataFrame | None,
    ignored: tuple[IgnoredRule, ...],
    source: Mapping[str, str],
) -> Outputs:
    """Filter, remove duplicates and summarise what is left.

    ``source`` tells which columns of the rows name a row of the audit.
    """
    rows = base.where(F.col(_KEPT)).drop(_KEPT, _WIDE)
    visible = [named(c) for c in rows.columns if c not in order]
    kept, removed = rows, None
    if duplicates.key_columns:
        kept = keep_first(rows, duplicates.key_columns, order)
        if duplicates.generate_report:
            removed = removed_duplicates(rows, duplicates.key_columns, order)
    consolidated = kept.select(*visible)
    return Outputs(
        ordered=kept,
        order=tuple(order),
        consolidated=consolidated,
        removed=None if removed is None else removed.select(*visible),
        summary=summary_table(consolidated, summary),
        summary_rule=summary,
        audit=audit,
        ignored_rules=ignored,
        accounting=_accounting(base, kept, audit, source),
        removed_ordered=removed,
        base=base,
        rebuild=lambda saved: _finish(saved, order, duplicates, summary, audit, ignored, source),
    )


def _accounting(base: DataFrame, kept: DataFrame, audit: DataFrame, source: Mapping[str, str]) -> DataFrame:
    """Rows of each source of the audit at each step; both counts are made before anything is shuffled."""
    read = base.groupBy(*source).agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(F.col(_WIDE)).alias("rows_wide"),
        F.count_if(F.col(_KEPT)).alias("rows_after_filter"),
    )
    left = kept.groupBy(*source).agg(F.count(F.lit(1)).alias("rows_left"))
    counts = read.join(left, list(source), "left").withColumnsRenamed(dict(source))

    def count(name: str) -> Column:
        return F.coalesce(name, F.lit(0))

    return audit.join(counts, list(source.values()), "left").select(
        *[named(c) for c in audit.columns],
        count("rows_read").alias("rows_read"),
        count("rows_wide").alias("rows_wide"),
        count("rows_after_filter").alias("rows_after_filter"),
        (count("rows_after_filter") - count("rows_left")).alias("rows_removed"),
        count("rows_left").alias("rows_left"),
    )


def consolidate(
    folder: Folder,
    mapping: DataFrame | None = None,
    filters: Sequence[FilterRule] = (),
    duplicates: DuplicateRule = NO_DUPLICATE_RULE,
    summary: SummaryRule = NO_SUMMARY,
    layout: DataFrame | None = None,
    sheets: SheetRule = SheetRule(),
    origin: str = C.ORIGIN,
    small_file_bytes: int = SMALL_FILE_BYTES,
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
    block_bytes: int | None = None,
) -> Outputs:
    """All sources of a folder as one table.

    One scan reads every delimited file, whatever their number; a small lookup
    per source says where its header is and which cell goes to which final
    column. Files above ``small_file_bytes`` are cut into blocks of ``block_bytes``. Pass the ``layout`` of an earlier analysis to use the same headers.
    """
    listed = None if layout is None else folder_files(folder)
    if layout is None:
        layout = read_layout(folder, sheets, small_file_bytes=small_file_bytes)
    projection = project_layout(layout, mapping)
    if not projection.columns:
        raise ValueError("no source column matches the mapping")

    grid = source_grid(folder, sheets, small_file_bytes, block_bytes or bytes_per_block(folder, projection.source_bytes))
    rows = join_layout(grid, projection, broadcast_limit)
    kept_names = [c for c in projection.columns if c.name != origin]
    text = mapped_cells(projection)
    present = present_columns(projection)
    flags = {c.name: f"__has_{i}" for i, c in enumerate(projection.columns)}
    order = [F.col(source).alias(name) for source, name in zip(("rank", "path", "sheet_no", "block", "line"), ROW_ORDER)]
    wide = (F.size("cells") > F.col("width")).alias(_WIDE)
    rows = rows.select(*text, *[present[n].alias(f) for n, f in flags.items()], F.col("origin").alias("__origin"), wide, *order)
    rows = rows.select(
        *[typed_text(named(c.name), c.type).alias(c.name) for c in projection.columns],
        *flags.values(),
        "__origin",
        _WIDE,
        *ROW_ORDER,
    )
    types = {c.name: SPARK_TYPES.get(c.type, StringType()) for c in projection.columns}
    compiled = compile_filter(filters, types, {n: F.col(f) for n, f in flags.items()})
    passes = F.lit(True) if compiled.predicate is None else compiled.predicate
    rows = rows.select(
        *[named(c.name) for c in kept_names], F.col("__origin").alias(origin), *ROW_ORDER, passes.alias(_KEPT), _WIDE
    )
    source = {"__path": "path", "__sheet_no": "sheet_no"}
    return _finish(rows, ROW_ORDER, duplicates, summary, audit_sources(projection, origin, listed), compiled.ignored, source)


@dataclass(frozen=True)
class TableMapping:
    """One entry for a column of a named table."""

    table: str
    column: str
    final_name: str
    type: str = C.TYPE_TEXT
    include: bool = True


def consolidate_tables(
    tables: Mapping[str, DataFrame],
    mapping: Sequence[TableMapping] = (),
    filters: Sequence[FilterRule] = (),
    duplicates: DuplicateRule = NO_DUPLICATE_RULE,
    summary: SummaryRule = NO_SUMMARY,
    order: Mapping[str, Collection[str]] | None = None,
    origin: str = C.ORIGIN,
) -> Outputs:
    """Tables that are already in Spark as one table, with the same rules.

    ``order`` names the columns that make each table's row order unique; it
    is needed to remove duplicates. Tables come in the given order.
    """
    if duplicates.key_columns and (order is None or set(tables) - set(order)):
        raise ValueError("removing duplicates needs the row order of every table")
    chosen = [m for m in mapping if m.include]
    labels = {m.final_name: m.type for m in chosen}
    order_columns = _order_columns(tables, order or {})
    frames, ignored, statuses = [], [], []
    for place, (name, table) in enumerate(tables.items()):
        targets = [(m.column, m.final_name) for m in chosen if m.table == name]
        matched = not mapping or bool(map_columns(table, targets))
        statuses.append((name, name, place, "processed" if matched else "unmatched", _replaced(table, targets, mapping, origin)))
        if not matched:
            continue
        projected = map_columns(table, targets) if mapping else [named(c) for c in table.columns]
        hidden = [F.lit(place).alias("__table")] + [
            named(c).cast(kind).alias(f"__order_{i}")
            for i, (c, kind) in enumerate(zip((order or {}).get(name, ()), order_columns))
        ]
        frame = table.select(*projected, *hidden)
        frame = frame.select(*[_labelled(frame, c, labels) for c in frame.columns])
        compiled = _filter_for(frame, filters)
        ignored.extend(i for i in compiled.ignored if i not in ignored)
        passes = F.lit(True) if compiled.predicate is None else compiled.predicate
        frames.append(add_origin(frame, name, column=origin).withColumn(_KEPT, passes).withColumn(_WIDE, F.lit(False)))
    if not frames:
        raise ValueError("no table column matches the mapping")
    row_order = ["__table"] + [f"__order_{i}" for i in range(len(order_columns))]
    rows = union_frames(harmonize(frames))
    visible = column_last(rows.select(*[named(c) for c in rows.columns if c not in (*row_order, _KEPT, _WIDE)]), origin).columns
    rows = rows.select(*[named(c) for c in visible], *row_order, _KEPT, _WIDE)
    audit = rows.sparkSession.createDataFrame(statuses, "origin string, path string, sheet_no int, status string, detail string")
    return _finish(rows, row_order, duplicates, summary, audit, tuple(ignored), {"__table": "sheet_no"})


def _replaced(table: DataFrame, targets: Sequence[tuple[str, str]], mapping: Sequence[TableMapping], origin: str) -> str | None:
    """What to say of a table whose own column of the origin's name gives way to the origin."""
    names = [final for _, final in targets] if mapping else table.columns
    return C.ORIGIN_REPLACED if origin in names else None


def _order_columns(tables: Mapping[str, DataFrame], order: Mapping[str, Collection[str]]) -> list:
    """Types of the order columns; tables must agree on them."""
    shapes = [[tables[name].select(named(c)).schema[0].dataType for c in columns] for name, columns in order.items()]
    if not shapes:
        return []
    if len({len(s) for s in shapes}) > 1:
        raise ValueError("tables must have the same number of order columns")
    common = [common_type(kinds) for kinds in zip(*shapes)]
    for kinds, target in zip(zip(*shapes), common):
        if len({type(common_type([k])) for k in kinds} | {type(target)}) > 1 and not _numeric(kinds):
            raise ValueError("order columns of different kinds cannot be compared")
    return common


def _numeric(kinds: Sequence) -> bool:
    return all(k.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal") for k in kinds)


def _labelled(frame: DataFrame, column: str, labels: Mapping[str, str]):
    """A column in the type its mapping asks for; text entries stay as they are."""
    label = labels.get(column, C.TYPE_TEXT)
    if label == C.TYPE_TEXT or label not in SPARK_TYPES:
        return named(column)
    return lenient_cast(named(column), frame.schema[column].dataType, SPARK_TYPES[label]).alias(column)


def _filter_for(frame: DataFrame, filters: Sequence[FilterRule]) -> CompiledFilter:
    return compile_filter(filters, {f.name: f.dataType for f in frame.schema})


def write_outputs(
    outputs: Outputs, path: str, kind: str = "parquet", which: Collection[str] = ("consolidated", "removed", "summary", "accounting")
) -> dict[str, str]:
    """Save the wanted tables as ``write_run`` does; returns where each one is."""
    return write_run(outputs, path, kind, which).places


def write_run(
    outputs: Outputs, path: str, kind: str = "parquet", which: Collection[str] = ("consolidated", "removed", "summary", "accounting")
) -> RunReport:
    """Save the wanted tables below ``path`` as ``parquet``, ``csv`` or ``sheets``, all of them or none.

    ``sheets`` cuts the consolidated and the removed rows into sheet-sized folders and strips what
    sheets cannot hold. The inputs are read once: their typed rows are saved in the shared folder,
    feed every output, and are removed at the end. The totals of the report are counted while these
    rows and the first output are written, without a job of their own. Outputs are published only when all are written.
    """
    if kind not in ("parquet", "csv", "sheets"):
        raise ValueError(f"unknown output kind: {kind}")
    if kind == "sheets" and outputs.summary is not None and outputs.summary_rule.only_summary:
        which = ("summary",)
    wanted = [part for part in _RESULT_NAMES if part in which and getattr(outputs, part) is not None]
    spark = outputs.base.sparkSession
    saved = shared_folder(spark)
    read, left = Observation(), Observation()
    counted = outputs.base.observe(
        read,
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(F.col(_WIDE)).alias("rows_wide"),
        F.count_if(F.col(_KEPT)).alias("rows_after_filter"),
    )
    try:
        counted.write.parquet(saved)
        outputs = outputs.rebuild(spark.read.schema(outputs.base.schema).parquet(saved))

        def write(part: str, place: str) -> None:
            _write_part(outputs, part, place, kind, left if part == "consolidated" else None)

        def totals() -> dict[str, int]:
            found = {"rows_read": 0, "rows_wide": 0, "rows_after_filter": 0, "rows_left": 0, **read.get}
            # only the result tells how many rows are left; where it is not wanted, the saved rows are counted
            found |= left.get if "consolidated" in wanted else {"rows_left": outputs.ordered.count()}
            return {**found, "rows_removed": found["rows_after_filter"] - found["rows_left"]}

        return publish(spark, path, {part: _RESULT_NAMES[part] for part in wanted}, write, totals)
    finally:
        removed_path(spark, saved)


_RESULT_NAMES = {
    "consolidated": C.SHEET_CONSOLIDATED,
    "removed": C.SHEET_REMOVED,
    "summary": C.SHEET_SUMMARY,
    "accounting": C.SHEET_ACCOUNTING,
}


def _write_part(outputs: Outputs, part: str, target: str, kind: str, counted: Observation | None = None) -> None:
    """Write one output; ``counted`` takes the number of its rows as they are written."""
    in_chunks = kind == "sheets" and part in ("consolidated", "removed")
    if in_chunks:
        table = outputs.chunks() if part == "consolidated" else outputs.removed_chunks()
    else:
        table = getattr(outputs, part)
    if kind == "sheets":
        table = sanitize_text(table)
    if counted is not None:  # last, as what lies below an exchange may be read more than once
        table = table.observe(counted, F.count(F.lit(1)).alias("rows_left"))
    if in_chunks:
        table.write.partitionBy("chunk").option("compression", "zstd").parquet(target)
    elif kind == "csv":
        write_csv(table, target)
    else:
        write_parquet(table, target)
