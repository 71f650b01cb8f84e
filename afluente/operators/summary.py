"""Grouped summary tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from afluente import constants as C
from afluente.functions.text import named


@dataclass(frozen=True)
class Aggregation:
    column: str
    operation: str


@dataclass(frozen=True)
class SummaryRule:
    group_by: tuple[str, ...] = ()
    aggregations: tuple[Aggregation, ...] = ()
    only_summary: bool = False


OPERATIONS: Mapping[str, Callable[[Column], Column]] = {
    C.SUM: lambda c: F.coalesce(F.sum(c), F.lit(0)),
    C.MEAN: F.avg,
    C.COUNT: F.count,
    C.MINIMUM: F.min,
    C.MAXIMUM: F.max,
    # null counts as one value
    C.UNIQUE_COUNT: lambda c: F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("bigint")), F.lit(0)),
}


def result_name(rule: Aggregation) -> str:
    return f"{rule.column}_{rule.operation.replace(' ', '_')}"


def applicable(df: DataFrame, rule: SummaryRule) -> list[Aggregation]:
    """Aggregations whose column and operation exist; the others are skipped."""
    return [a for a in rule.aggregations if a.column in df.columns and a.operation in OPERATIONS]


def summary_table(df: DataFrame, rule: SummaryRule) -> DataFrame | None:
    """One row per group, sorted by the group columns with nulls first; None without anything to compute."""
    usable = applicable(df, rule)
    if not rule.group_by or not usable:
        return None
    missing = [g for g in rule.group_by if g not in df.columns]
    if missing:
        raise ValueError(f"summary group columns not found: {', '.join(missing)}")
    keys = [named(g) for g in rule.group_by]
    results = [OPERATIONS[a.operation](named(a.column)).alias(result_name(a)) for a in usable]
    return df.groupBy(*keys).agg(*results).orderBy(*keys)
