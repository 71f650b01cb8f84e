"""Origin, common types, union, and removal of duplicate rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from afluente import constants as C
from afluente.functions.casts import lenient_cast
from afluente.functions.columns import free_name
from afluente.functions.text import named
from afluente.functions.types import common_type


@dataclass(frozen=True)
class DuplicateRule:
    key_columns: tuple[str, ...] = ()
    generate_report: bool = True


def origin_text(file: Column, sheet: Column) -> Column:
    """``file`` or ``file (sheet)``."""
    return F.when(sheet.isNull(), file).otherwise(F.concat(file, F.lit(" ("), sheet, F.lit(")")))


def add_origin(df: DataFrame, file: str, sheet: str | None = None, column: str = C.ORIGIN) -> DataFrame:
    """Tag a table with where it came from; a column of that name is replaced."""
    return df.withColumn(column, F.lit(f"{file} ({sheet})" if sheet else file))


def column_last(df: DataFrame, column: str = C.ORIGIN) -> DataFrame:
    if column not in df.columns:
        return df
    return df.select(*[named(c) for c in df.columns if c != column], named(column))


def type_census(frames: Iterable[DataFrame]) -> dict[str, set[T.DataType]]:
    """Types of each column over all frames, in first-seen order; reads schemas only."""
    seen: dict[str, set[T.DataType]] = {}
    for frame in frames:
        for f in frame.schema:
            seen.setdefault(f.name, set()).add(f.dataType)
    return seen


def census_table(frames: Sequence[DataFrame]) -> DataFrame:
    """(column, types, filled) over all frames: the types met and the cells that are not null."""

    def counted(frame: DataFrame) -> DataFrame:
        columns = [
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.count(named(f.name)).alias("filled"),
            )
            for f in frame.schema
        ]
        return frame.agg(F.array(*columns).alias("columns")).select(F.inline("columns"))

    counts = counted(frames[0])
    for frame in frames[1:]:
        counts = counts.unionAll(counted(frame))
    types = F.array_join(F.array_sort(F.collect_set("type")), ",")
    return counts.groupBy("column").agg(types.alias("types"), F.sum("filled").alias("filled"))


def harmonize(frames: Sequence[DataFrame]) -> list[DataFrame]:
    """The frames with every column in the common type of its namesakes."""
    targets = {name: common_type(types) for name, types in type_census(frames).items()}

    def fitted(field: T.StructField) -> Column:
        column, target = named(field.name), targets[field.name]
        if target is None or target == field.dataType:
            return column
        return lenient_cast(column, field.dataType, target).alias(field.name)

    return [frame.select(*[fitted(f) for f in frame.schema]) for frame in frames]


def union_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows under all columns in first-seen order; missing columns are null."""
    if not frames:
        raise ValueError("nothing to combine")
    schema: dict[str, T.DataType] = {}
    for frame in frames:
        for f in frame.schema:
            schema.setdefault(f.name, f.dataType)
    _check_case(frames[0], list(schema))

    def widened(frame: DataFrame) -> DataFrame:
        own = set(frame.columns)
        return frame.select(
            *[named(n) if n in own else F.lit(None).cast(t).alias(n) for n, t in schema.items()]
        )

    combined = widened(frames[0])
    for frame in frames[1:]:
        combined = combined.unionAll(widened(frame))
    return combined


def _check_case(df: DataFrame, names: Sequence[str]) -> None:
    """Column names that differ only in letter case need a session that tells them apart."""
    if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true":
        return
    spelled: dict[str, str] = {}
    for name in names:
        other = spelled.setdefault(name.lower(), name)
        if other != name:
            raise ValueError(f"set spark.sql.caseSensitive to keep columns {other!r} and {name!r} apart")


def combine(frames: Mapping[str, DataFrame], origin: str = C.ORIGIN) -> DataFrame:
    """Tagged, harmonised union of named tables."""
    tagged = [add_origin(frame, name, column=origin) for name, frame in frames.items()]
    return column_last(union_frames(harmonize(tagged)), origin)


def _check_keys(df: DataFrame, keys: Sequence[str]) -> None:
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"duplicate key columns not found: {', '.join(missing)}")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, by a total ``order``; null keys equal each other.

    Each map task sends at most one row per key, so a key that holds a large
    share of all rows does not weigh on the task that decides about it.
    """
    _check_keys(df, keys)
    by_key = W.partitionBy(*[named(k) for k in keys]).orderBy(*[named(o) for o in order])
    place = free_name("_place", df.columns)
    return df.withColumn(place, F.row_number().over(by_key)).where(F.col(place) == 1).drop(place)


def removed_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Every row that ``keep_first`` drops.

    Rows meet their survivor on ``order``, never on the key, so the copies of
    one key spread over all tasks. ``order`` must be unique over the rows; a
    null in it is a value like any other.
    """
    kept = keep_first(df.select(*[named(c) for c in dict.fromkeys([*keys, *order])]), keys, order)
    kept = kept.select(*[named(o).alias(f"__kept_{i}") for i, o in enumerate(order)])
    same = reduce(and_, [named(o).eqNullSafe(kept[f"__kept_{i}"]) for i, o in enumerate(order)])
    return df.join(kept, same, "left_anti")


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows before, removed and left; keys are counted before they are shuffled."""
    _check_keys(df, keys)
    per_key = df.groupBy(*[named(k) for k in keys]).agg(F.count(F.lit(1)).alias("rows"))
    before, left = F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))
    return per_key.agg(before.alias("rows_before"), (before - left).alias("rows_removed"), left.alias("rows_left"))
