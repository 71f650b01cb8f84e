"""Finding the header row of a raw grid and naming its columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from afluente import constants as C
from afluente.functions.columns import computed
from afluente.functions.text import SPACES, is_visible

# Weights of the header score.
UNIQUE_WEIGHT = 3.0
TEXT_WEIGHT = 3.0
NUMERIC_WEIGHT = 5.0
NULL_WEIGHT = 2.0
SAME_KIND_PENALTY = 0.2
TRANSITION_WEIGHT = 5.0
ALL_NULL_SCORE = -100.0

# Fixed value: a cell that is a number to the header score, white space around it aside.
NUMERIC_CELL = rf"^{SPACES}*\p{{N}}+{SPACES}*\z"


def filled_cells(cells: Column) -> Column:
    return F.filter(cells, lambda c: c.isNotNull())


def row_stats(cells: Column, filled: Column | None = None) -> Column:
    """Counts of null, visible, numeric and distinct cells in one row; ``filled`` are its cells that are not null."""
    filled = filled_cells(cells) if filled is None else filled
    return F.struct(
        F.size(cells).alias("width"),
        (F.size(cells) - F.size(filled)).alias("nulls"),
        F.size(F.filter(filled, is_visible)).alias("texts"),
        F.size(F.filter(filled, lambda c: c.rlike(NUMERIC_CELL))).alias("numerics"),
        F.size(F.array_distinct(filled)).alias("uniques"),
    )


def same_kind_count(cells: Column, below: Column) -> Column:
    """Columns whose cell and the cell below are both null or both filled."""
    same = F.zip_with(cells, below, lambda a, b: (a.isNull() == b.isNull()).cast("int"))
    return F.aggregate(same, F.lit(0), lambda total, one: total + one)


def transition_score(same: Column, width: Column) -> Column:
    """Penalty for rows that look like the row below, subtracted column by column."""
    total = F.aggregate(
        F.sequence(F.lit(1), same), F.lit(0.0), lambda score, _: score - F.lit(SAME_KIND_PENALTY)
    )
    return F.when(same > 0, total).otherwise(F.lit(0.0)) / width * F.lit(TRANSITION_WEIGHT)


def content_score(stats: Column) -> Column:
    """How much one row looks like a header on its own."""
    filled = (stats["width"] - stats["nulls"]).cast("double")
    shares = (
        stats["uniques"] / filled * F.lit(UNIQUE_WEIGHT)
        + stats["texts"] / filled * F.lit(TEXT_WEIGHT)
        - stats["numerics"] / filled * F.lit(NUMERIC_WEIGHT)
        - stats["nulls"] / stats["width"] * F.lit(NULL_WEIGHT)
    )
    return F.when(filled == 0, F.lit(ALL_NULL_SCORE)).otherwise(shares)


def header_line(rows: Column) -> Column:
    """0-based header row of an array of rows: best score, earliest on a tie, 0 if there is no choice."""
    # Each step binds what the next one mentions more than once; a plain nested column would be worked out per mention.
    pairs = F.transform(
        rows, lambda r, i: F.struct(r.alias("cells"), filled_cells(r).alias("filled"), F.get(rows, i + 1).alias("below"))
    )
    counted = F.transform(
        F.slice(pairs, F.lit(1), F.greatest(F.size(rows) - 1, F.lit(0))),
        lambda p: F.struct(
            row_stats(p["cells"], p["filled"]).alias("stats"), same_kind_count(p["cells"], p["below"]).alias("same")
        ),
    )

    def score(c: Column) -> Column:
        return content_score(c["stats"]) + transition_score(c["same"], c["stats"]["width"])

    ranked = F.transform(counted, lambda c, i: F.struct(score(c).alias("score"), (-i).alias("early")))
    return F.when(F.size(rows) < 2, F.lit(0)).otherwise(-F.array_max(ranked)["early"])


def header_names(cells: Column) -> Column:
    """Names of all columns; an unnamed one is called by its position."""
    return F.transform(
        cells, lambda c, i: F.coalesce(c, F.concat(F.lit(C.UNNAMED_COLUMN), i.cast("string")))
    )


def with_unique_names(df: DataFrame, names: Column, output: str = "names") -> DataFrame:
    """Names that occur more than once all get ``_1``, ``_2``, … in order.

    The names are sorted so that equal ones form runs; each run numbers itself,
    and the original order is restored.
    """
    entries = F.transform(names, lambda n, i: F.struct(n.alias("name"), i.alias("at")))
    df = computed(df, _sorted=F.array_sort(entries))

    def name_at(position: Column) -> Column:
        return F.get("_sorted", position)["name"]

    positions = F.when(F.size("_sorted") > 0, F.sequence(F.lit(0), F.size("_sorted") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    df = computed(df, _starts=F.filter(positions, lambda k: (k == 0) | (name_at(k) != name_at(k - 1))))

    def run(start: Column, number: Column) -> Column:
        length = F.coalesce(F.get("_starts", number + 1), F.size("_sorted")) - start

        def numbered(entry: Column, place: Column) -> Column:
            suffixed = F.concat(entry["name"], F.lit("_"), (place + 1).cast("string"))
            return F.struct(entry["at"].alias("at"), F.when(length > 1, suffixed).otherwise(entry["name"]).alias("name"))

        return F.transform(F.slice("_sorted", start + 1, length), numbered)

    restored = F.array_sort(F.flatten(F.transform("_starts", run)))
    return computed(df, **{output: F.transform(restored, lambda e: e["name"])}).drop("_sorted", "_starts")


def detect_layout(heads: DataFrame) -> DataFrame:
    """Header row, column names and status of each source."""
    sampled = computed(heads, _sampled=F.slice("rows", 1, C.HEAD_ROWS))
    found = computed(sampled, header_line=header_line(F.col("_sampled"))).drop("_sampled")
    return _judged(with_unique_names(found, header_names(_header_cells())))


def _header_cells() -> Column:
    return F.coalesce(F.get("rows", F.col("header_line")), F.array().cast("array<string>"))


def _judged(found: DataFrame) -> DataFrame:
    """Sources with a status, from their rows, names and errors."""
    clash = F.size(F.array_distinct("names")) < F.size("names")
    status = (
        F.when(F.col("error") == C.HIDDEN_NAME, "skipped")
        .when(F.col("error").isNotNull(), "error")
        .when(F.size("rows") < 2, "empty")
        .when(clash, "error")
        .otherwise("ok")
    )
    detail = F.coalesce("error", F.when(clash, F.lit("column names are not unique")))
    return computed(found, status=status, _detail=detail).withColumn("error", F.col("_detail")).drop("_detail")


def widened(layout: DataFrame, widths: DataFrame) -> DataFrame:
    """A layout whose sources have a column for every cell of their widest row.

    ``widths`` holds (uri, sheet_no, width). The header row stays where it was found; columns beyond it are called by
    their position, as unnamed ones always are.
    """
    found = layout.drop("names", "status").join(widths.select("uri", "sheet_no", F.col("width").alias("_widest")), ["uri", "sheet_no"], "left")
    header = _header_cells()
    beyond = F.greatest(F.coalesce("_widest", F.lit(0)) - F.size(header), F.lit(0))
    found = computed(found, _header=F.concat(header, F.array_repeat(F.lit(None).cast("string"), beyond)))
    # a source without rows has no header to widen
    names = header_names(F.when(F.size("rows") > 0, F.col("_header")).otherwise(header))
    return _judged(with_unique_names(found, names)).select(*layout.columns)


def numbered_grid(grid: DataFrame, source: list[str], line: str = "line", rows: int = C.HEAD_ROWS) -> DataFrame:
    """First ``rows`` lines of each source; only those leave the map side."""
    order = W.partitionBy(*source).orderBy(line)
    return grid.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= rows).drop("_n")


def grid_heads(grid: DataFrame, source: list[str], line: str = "line", rows: int = C.HEAD_ROWS) -> DataFrame:
    """First lines of each source of an exploded grid as one array of rows."""
    first = numbered_grid(grid, source, line, rows).groupBy(*source)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(line).alias("line"), "cells")))
    return first.agg(F.transform(ordered, lambda r: r["cells"]).alias("rows"))


def drop_preamble(grid: DataFrame, line: str = "line", header: str = "header_line") -> DataFrame:
    """Rows after the header row; ``header`` comes with each row from its layout."""
    return grid.where(F.col(line) > F.col(header))


def positional_rename(cells: Column, names: list[str]) -> list[Column]:
    """Cells as columns called by the header names."""
    return [F.get(cells, F.lit(i)).alias(name) for i, name in enumerate(names)]
