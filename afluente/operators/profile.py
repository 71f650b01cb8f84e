"""Type profile of text columns, and groups of columns that seem to mean the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from afluente.functions.casts import text_to_datetime, text_to_float, text_to_integer
from afluente.functions.text import blank_to_null, is_visible, named, normalize_name
from afluente.session import written

# Profiled types, from the most specific one.
INTEGER, FLOAT, DATETIME, TEXT = "Int64", "Float64", "Datetime", "String"

# One bit per kind of cell, so that the kinds met in a column add up by OR.
_NO_KIND, _INTEGER, _FLOAT, _DATETIME, _TEXT = 0, 1, 2, 4, 8

NUMERIC_CLASS = "numeric"


def _cell_kind(value: Column) -> Column:
    """Most specific kind that one cell fits; white space fits none."""
    return (
        F.when(~is_visible(value), F.lit(_NO_KIND))
        .when(text_to_integer(value).isNotNull(), F.lit(_INTEGER))
        .when(text_to_float(value).isNotNull(), F.lit(_FLOAT))
        .when(text_to_datetime(value).isNotNull(), F.lit(_DATETIME))
        .otherwise(F.lit(_TEXT))
    )


def _type_of(kinds: Column) -> Column:
    """Type that all cells of the given kinds fit."""
    return (
        F.when(kinds == _INTEGER, INTEGER)
        .when(kinds.isin(_FLOAT, _FLOAT | _INTEGER), FLOAT)
        .when(kinds == _DATETIME, DATETIME)
        .otherwise(TEXT)
    )


def profile_column(value: Column) -> Column:
    """Type of a text column, as one aggregate."""
    return _type_of(F.coalesce(F.bit_or(_cell_kind(value)), F.lit(_NO_KIND)))


def null_ratio(value: Column) -> Column:
    return F.avg(value.isNull().cast("double"))


def table_fingerprints(df: DataFrame, path: str) -> DataFrame:
    """One row per column of a table, all cells taken as text; the table is read once and not shuffled."""
    columns = [
        F.struct(
            F.lit(i).alias("column_no"),
            F.lit(name).alias("column"),
            profile_column(named(name).cast("string")).alias("type"),
            null_ratio(named(name)).alias("null_ratio"),
        )
        for i, name in enumerate(df.columns)
    ]
    found = df.agg(F.array(*columns).alias("columns")).select(F.inline("columns"))
    return found.select(
        F.lit(path).alias("path"),
        F.lit(path).alias("file"),
        F.lit(0).alias("rank"),
        F.lit(None).cast("string").alias("sheet"),
        F.lit(0).alias("sheet_no"),
        "column_no",
        "column",
        normalize_name(F.col("column")).alias("normalized"),
        "type",
        "null_ratio",
    )


def column_counts(rows: DataFrame) -> DataFrame:
    """Cells, filled cells and kinds of each column of each source, saved; from ``rows`` (uri, sheet_no, cells).

    Cells are counted by source and column before they are shuffled, so a source that holds a large
    share of all rows sends no more than a small one.
    """
    cell = blank_to_null(F.col("cell"))
    return written(
        rows.select("uri", "sheet_no", F.posexplode("cells").alias("column_no", "cell"))
        .groupBy("uri", "sheet_no", "column_no")
        .agg(F.count(F.lit(1)).alias("cells"), F.count(cell).alias("filled"), F.bit_or(_cell_kind(cell)).alias("kinds"))
    )


def widest_rows(counts: DataFrame) -> DataFrame:
    """(uri, sheet_no, width) from the counts of ``column_counts``."""
    return counts.groupBy("uri", "sheet_no").agg((F.max("column_no") + 1).alias("width"))


def source_fingerprints(rows: DataFrame, layout: DataFrame) -> DataFrame:
    """One row per column of each source, from all ``rows`` (uri, sheet_no, cells) below the headers."""
    return fingerprints_of(column_counts(rows), layout)


def fingerprints_of(counts: DataFrame, layout: DataFrame) -> DataFrame:
    """One row per column of each source, from the counts of its columns. A row without a cell in a column counts as null."""
    columns = layout.where(F.col("status") == "ok").select(
        "uri", "path", "file", "rank", "sheet", "sheet_no", F.posexplode("names").alias("column_no", "column")
    )
    # every row has a first cell
    totals = counts.where(F.col("column_no") == 0).select("uri", "sheet_no", F.col("cells").alias("total"))
    found = columns.join(counts, ["uri", "sheet_no", "column_no"], "left").join(totals, ["uri", "sheet_no"], "left")
    filled = F.coalesce("filled", F.lit(0))
    return found.select(
        "path",
        "file",
        "rank",
        "sheet",
        "sheet_no",
        "column_no",
        "column",
        normalize_name(F.col("column")).alias("normalized"),
        ((F.col("total") - filled) / F.col("total")).alias("null_ratio"),
        _type_of(F.coalesce("kinds", F.lit(_NO_KIND))).alias("type"),
    )


def type_class(kind: Column) -> Column:
    return F.when(kind.isin(INTEGER, FLOAT), NUMERIC_CLASS).otherwise(kind)


def group_headers(fingerprints: DataFrame) -> DataFrame:
    """Members of each group: columns with one normalised name and one class of type.

    The group is a pure function of the member, so no shuffle is needed and a
    name found in every file never gathers in one place.
    """
    kind = type_class(F.col("type"))
    # A name of which nothing is left, as one in another script, stands for itself.
    name = F.when(F.col("normalized") == "", F.lower("column")).otherwise(F.col("normalized"))
    return fingerprints.select(
        F.concat_ws(":", name, kind).alias("group_id"),
        F.lit(0).alias("tier"),
        F.array().cast("array<int>").alias("lead"),
        name.alias("normalized"),
        kind.alias("type_class"),
        "column",
        "path",
        "sheet",
        F.struct("rank", "path", "sheet_no", "column_no").alias("position"),
    )


def describe_groups(members: DataFrame) -> DataFrame:
    """One row per group: suggested name (that of its first member), size and display order."""
    first = F.struct("lead", "position")
    groups = members.groupBy("group_id", "tier").agg(
        F.min_by("column", first).alias("suggested"),
        F.min_by("normalized", first).alias("normalized"),
        F.min(first).alias("first"),
        F.count(F.lit(1)).alias("members"),
    )
    # Groups of one name stay together; a name has at most one group per class of type.
    of_name = F.min("first").over(W.partitionBy("tier", "normalized"))
    return groups.withColumn("display", F.struct("tier", of_name.alias("name"), "first")).drop("first")
