"""The mapping from source columns to final columns, and edits of it."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from afluente import constants as C
from afluente.functions.text import named
from afluente.operators.profile import describe_groups
from afluente.session import BROADCAST_LIMIT_BYTES

MAPPING_COLUMNS = ("column", "path", "sheet", "final_name", "type", "include", "entry")


def mapping_from_rows(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """A mapping from (column, path, sheet, final_name, type, include) rows, in order."""
    numbered = [(*row, position) for position, row in enumerate(rows)]
    return spark.createDataFrame(
        numbered,
        "column string, path string, sheet string, final_name string, type string, include boolean, entry int",
    )


def default_settings(members: DataFrame) -> DataFrame:
    """Each group with its suggested name, as text and included."""
    return describe_groups(members).select(
        "group_id",
        "suggested",
        F.col("suggested").alias("final_name"),
        F.lit(C.TYPE_TEXT).alias("type"),
        F.lit(True).alias("include"),
        "display",
    )


def override_mapping(settings: DataFrame, overrides: DataFrame, key: Sequence[str] = ("group_id",)) -> DataFrame:
    """User changes by key; a null in ``overrides`` keeps the present value."""
    fields = [f for f in ("final_name", "type", "include") if f in overrides.columns]
    changes = overrides.select(*key, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = settings.join(changes, list(key), "left")
    return joined.select(
        *[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in settings.columns]
    )


def split_groups(members: DataFrame, moves: DataFrame, tier: int = 1) -> DataFrame:
    """Move members to new groups, shown last.

    ``moves`` holds (group_id, column, path, sheet, new_group_id). A group whose
    members all leave is gone; one that has a single member cannot be split.
    """
    target = moves.select(
        F.col("group_id").alias("_group"),
        F.col("column").alias("_column"),
        F.col("path").alias("_path"),
        F.col("sheet").alias("_sheet"),
        F.col("new_group_id").alias("_new"),
    )
    same = (
        (F.col("group_id") == F.col("_group"))
        & (F.col("column") == F.col("_column"))
        & (F.col("path") == F.col("_path"))
        & F.col("sheet").eqNullSafe(F.col("_sheet"))
    )
    splittable = members.groupBy("group_id").agg((F.count(F.lit(1)) > 1).alias("_splittable"))
    allowed = target.join(splittable, F.col("_group") == F.col("group_id")).where("_splittable").drop("group_id", "_splittable")
    moved = F.col("_new").isNotNull()
    return members.join(allowed, same, "left").select(
        F.coalesce("_new", "group_id").alias("group_id"),
        F.when(moved, F.lit(tier)).otherwise(F.col("tier")).alias("tier"),
        *[c for c in members.columns if c not in ("group_id", "tier")],
    )


def merge_groups(members: DataFrame, groups: Sequence[str], merged_id: str, tier: int = -1) -> DataFrame:
    """Two or more groups, given in display order, become one that is shown first.

    The members of the last group lead, so that group gives the suggested name.
    """
    if len(set(groups)) < 2:
        raise ValueError("merging takes two groups or more")
    place = F.array_position(F.array(*[F.lit(g) for g in reversed(groups)]), F.col("group_id")).cast("int")
    chosen = F.col("group_id").isin(*groups)
    return members.select(
        F.when(chosen, F.lit(merged_id)).otherwise(F.col("group_id")).alias("group_id"),
        F.when(chosen, F.lit(tier)).otherwise(F.col("tier")).alias("tier"),
        F.when(chosen, F.concat(F.array(place), "lead")).otherwise(F.col("lead")).alias("lead"),
        *[c for c in members.columns if c not in ("group_id", "tier", "lead")],
    )


def build_mapping(members: DataFrame, settings: DataFrame, broadcast_limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """One row per source column. A blank final name falls back to the suggested one.

    The settings go to every task while their measured size allows. Beyond that only those of hot groups do, such as a
    name that every file has: no more groups than there are partitions can each hold a partition's share of the members.
    The other members meet their settings by group.
    """
    name = F.coalesce(F.nullif(F.trim("final_name"), F.lit("")), "suggested")
    chosen = settings.select("group_id", name.alias("final_name"), "type", "include", "display")
    size = settings.agg(F.sum(F.length("group_id") + F.length(F.coalesce(name, F.lit(""))) + 64).alias("bytes")).first()["bytes"]
    if (size or 0) <= broadcast_limit:
        joined = members.join(F.broadcast(chosen), "group_id")
    else:
        joined = _join_by_group(members, chosen)
    return joined.select(
        "column", "path", "sheet", "final_name", "type", "include", F.struct("display", "lead", "position").alias("entry")
    )


def _join_by_group(members: DataFrame, chosen: DataFrame) -> DataFrame:
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("_members"))
    share = -(-(counts.agg(F.sum("_members")).first()[0] or 0) // parts)
    hot = counts.where(F.col("_members") > share).select("group_id", F.lit(True).alias("_hot"))
    marked = members.join(F.broadcast(hot), "group_id", "left")  # fewer groups than partitions
    of_hot = chosen.join(F.broadcast(hot), "group_id")
    met = marked.where(F.col("_hot")).drop("_hot").join(F.broadcast(of_hot.drop("_hot")), "group_id")
    return met.unionByName(marked.where(F.col("_hot").isNull()).drop("_hot").join(chosen, "group_id"))


def final_columns(mapping: DataFrame) -> DataFrame:
    """Distinct included final names with their type; the last included entry sets it."""
    return (
        mapping.where("include")
        .groupBy("final_name")
        .agg(F.max_by("type", "entry").alias("type"))
        .withColumn("numeric", F.col("type").isin(*C.NUMERIC_TYPES))
    )


def join_mapping(columns: DataFrame, mapping: DataFrame) -> DataFrame:
    """Source columns (path, sheet, column, …) with the included entry that names them."""
    entries = mapping.where("include").select(
        F.col("column").alias("_column"), F.col("path").alias("_path"), F.col("sheet").alias("_sheet"), "final_name"
    )
    same = (
        (F.col("column") == F.col("_column"))
        & (F.col("path") == F.col("_path"))
        & F.col("sheet").eqNullSafe(F.col("_sheet"))
    )
    return columns.join(entries, same).drop("_column", "_path", "_sheet")


def coalesce_columns(sources: Sequence[Column]) -> Column:
    """First non-null among the columns that share a final name."""
    return F.coalesce(*sources) if len(sources) > 1 else sources[0]


def map_columns(df: DataFrame, targets: Sequence[tuple[str, str]]) -> list[Column]:
    """Projection of a table under (source column, final name) pairs.

    Columns of one final name are coalesced in table order, and final names
    come in the order in which they are first met.
    """
    wanted: dict[str, list[str]] = dict()
    names = dict(targets)
    for column in df.columns:
        if column in names:
            wanted.setdefault(names[column], []).append(column)
    return [coalesce_columns([named(c) for c in columns]).alias(final) for final, columns in wanted.items()]
