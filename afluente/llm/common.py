"""Helpers shared by the text operators."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Text bytes that a Python task handles at once, and the rows a batch may have.
SLICE_BYTES = 4 << 20
ARROW_ROWS = 1024


def texts_of(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, null texts as empty ones."""
    id_column, text = documents["doc_id"].cast("long"), documents["text"].cast("string")
    return documents.select(id_column.alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))


def fresh_worker() -> None:
    """Give back what the task before has left in this Python worker."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def small_batches(spark: SparkSession) -> None:
    """Keep batches to Python small where the session still has the default of 10,000 rows."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` has about ``limit`` bytes in each piece, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls, and the bounds of its rows in them."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    everything = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return everything[bounds[0] : bounds[-1]], bounds - bounds[0]


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``start … start + length - 1`` of every span, one span after the other."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts.astype(np.int64) - (ends - lengths), lengths) + np.arange(total)


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bounds(rows: DataFrame, count: int) -> list[int]:
    """Ids that cut the rows into at most ``count`` ranges of about as many rows; each is the id of a row."""
    if count < 2:
        return []
    shares = [k / count for k in range(1, count)]
    found = rows.agg(F.percentile_approx("doc_id", F.lit(shares), F.lit(max(10_000, 20 * count)))).first()[0]
    return sorted(set(found or []))


def in_id_order(rows: DataFrame, bounds: list[int], with_next: bool = False, made=None, schema: str | None = None) -> DataFrame:
    """The rows dealt out by ranges of ``doc_id`` between ``bounds`` and sorted by all columns within each range.

    Column ``part`` numbers the ranges. With ``with_next`` a range also gets, marked ``tail``, the rows of the first
    id of the next range (the last range: of the first range), so that each row can be seen with its follower. Null
    ids come first. ``made`` turns batches of the rows into batches of ``schema`` before they are dealt out, in the same
    Python worker, which halves the workers that a task needs. Only the range bounds, one id per partition, pass through the driver.
    """
    schema = schema or ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    columns, last = [name.split()[0].strip("`") for name in schema.split(", ")], len(bounds)
    first = rows.agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("low")).first()["low"] if with_next else None
    nobody, lowest = first is None, first[1] if first is not None else None
    edges = np.array(bounds, dtype=np.int64)

    def deal(batches):
        for batch in made(batches) if made else batches:
            ids = batch.column("doc_id")
            empty = ids.is_null().to_numpy(zero_copy_only=False)
            values = ids.fill_null(0).to_numpy(zero_copy_only=False)
            part = np.where(empty, 0, np.searchsorted(edges, values, side="right")).astype(np.int32)
            rows_in = [batch.column(name) for name in columns]
            yield pa.RecordBatch.from_arrays(
                [*rows_in, pa.array(part), pa.array(np.zeros(len(part), bool))], [*columns, "part", "tail"]
            )
            if with_next and not nobody:
                at_edge = ~empty & (part > 0) & (values == edges[np.maximum(part, 1) - 1] if last else False)
                at_first = empty if lowest is None else ~empty & (values == lowest)
                for again, to in ((at_edge, part - 1), (at_first, np.full_like(part, last))):
                    if again.any():
                        chosen = pa.array(np.flatnonzero(again))
                        yield pa.RecordBatch.from_arrays(
                            [*(c.take(chosen) for c in rows_in), pa.array(to[again].astype(np.int32)), pa.array(np.ones(int(again.sum()), bool))],
                            [*columns, "part", "tail"],
                        )

    dealt = rows.mapInArrow(deal, f"{schema}, part int, tail boolean")
    return dealt.repartitionById(last + 1, F.col("part")).sortWithinPartitions("part", "tail", *columns)
