"""Sinks, row numbers, sheet-sized chunks and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from afluente import constants as C
from afluente.functions.casts import fraction_to_text
from afluente.functions.columns import free_name
from afluente.functions.text import named, strip_controls
from afluente.session import written

_ROW_IN_TASK = (1 << 33) - 1


def sanitize_text(df: DataFrame) -> DataFrame:
    """Text columns without the control characters that sheets cannot hold."""
    return df.select(
        *[
            strip_controls(named(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else named(f.name)
            for f in df.schema
        ]
    )


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Pipe-separated text with a header; cells are written as they are."""
    (
        df.write.mode(mode)
        .option("sep", "|")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_csv(spark, path: str, schema: str | T.StructType) -> DataFrame:
    """Read back what ``write_csv`` wrote; an empty field is null."""
    return (
        spark.read.schema(schema)
        .option("sep", "|")
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path)
    )


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def _offsets(counts: DataFrame, part: str, before: str, total: str) -> DataFrame:
    """Rows before each part and rows in all, from one (part, rows) line per part."""
    ordered = W.orderBy(part)
    earlier = F.sum("rows").over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("rows")
    everything = F.sum("rows").over(ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return counts.select(part, earlier.alias(before), everything.alias(total))


def row_index(df: DataFrame, order: Sequence[str], index: str = "row_index", parts: int | None = None) -> DataFrame:
    """Dense 0-based position of every row under a total ``order``."""
    numbered, position, _ = _numbered(df, order, parts)
    return numbered.select(*[named(c) for c in df.columns], F.col(position).alias(index))


def _numbered(df: DataFrame, order: Sequence[str], parts: int | None) -> tuple[DataFrame, str, str]:
    """``df`` with the position of each row and the number of all, and the names of these two columns.

    Rows are dealt out by ranges and sorted once, and saved with their range and their place in it; ranges are sampled
    anew by each run, so they must be saved before they are counted. The sizes of the ranges come from that one column
    of the saved rows, and only they, one number per range, come together; positions are added when the rows are read.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [named(o) for o in order]
    part, spot, before, index, total = (free_name(n, df.columns) for n in ("_part", "_place", "_before", "_index", "_total"))
    ranged = written(
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn(part, F.spark_partition_id())
        .withColumn(spot, F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_IN_TASK)))
    )
    offsets = _offsets(ranged.groupBy(part).agg(F.count(F.lit(1)).alias("rows")), part, before, total)
    # one row per range, so never more than ``parts``
    placed = ranged.join(F.broadcast(offsets), part)
    return placed.withColumn(index, F.col(before) + F.col(spot)), index, total


def chunk_rows(
    df: DataFrame,
    order: Sequence[str],
    rows_per_chunk: int = C.ROWS_PER_SHEET,
    name: str = C.SHEET_CONSOLIDATED,
    parts: int | None = None,
) -> DataFrame:
    """Rows with the sheet-sized block they belong to; a single block has no number in its name."""
    numbered, index, total = _numbered(df, order, parts)
    chunk = F.floor(F.col(index) / F.lit(rows_per_chunk)) + 1
    label = F.when(F.col(total) <= rows_per_chunk, F.lit(name)).otherwise(
        F.concat(F.lit(f"{name}_"), chunk.cast("string"))
    )
    return numbered.select(*[named(c) for c in df.columns], label.alias("chunk"))


def display_widths(df: DataFrame) -> DataFrame:
    """Width of each column on screen, as (column, width)."""

    def text(name: str) -> Column:
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            return fraction_to_text(named(name))
        return named(name).cast("string")

    def width(name: str) -> Column:
        longest = F.coalesce(F.max(F.length(text(name))), F.lit(0))
        wanted = F.greatest(F.lit(len(name)), longest, F.lit(1)) + F.lit(C.DISPLAY_PADDING)
        return F.struct(
            F.lit(name).alias("column"), F.least(wanted, F.lit(C.MAX_DISPLAY_WIDTH)).alias("width")
        )

    return df.agg(F.array(*[width(c) for c in df.columns]).alias("widths")).select(F.inline("widths"))


def row_accounting(df: DataFrame, kept: Column, origin: str = C.ORIGIN) -> DataFrame:
    """Rows per origin before and after a filter."""
    return df.groupBy(named(origin).alias(origin)).agg(
        F.count(F.lit(1)).alias("rows_before"), F.count_if(F.coalesce(kept, F.lit(False))).alias("rows_after")
    )
