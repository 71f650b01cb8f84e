"""Which sheets of the listed workbooks take part in a run."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SheetRule:
    """Keep (``include``) or drop (``exclude``) sheets by name; no names means no rule."""

    mode: str = "include"
    names: Collection[str] = field(default_factory=frozenset)

    def __post_init__(self) -> None:
        if self.mode not in ("include", "exclude"):
            raise ValueError(f"unknown sheet rule mode: {self.mode}")


def distinct_sheets(inventory: DataFrame) -> DataFrame:
    return inventory.where(F.col("sheet").isNotNull()).select("sheet").distinct().orderBy("sheet")


def apply_sheet_rule(inventory: DataFrame, rule: SheetRule) -> DataFrame:
    """Delimited files have no sheet and always stay."""
    if not rule.names:
        return inventory
    listed = F.col("sheet").isin(*sorted(rule.names))
    wanted = listed if rule.mode == "include" else ~listed
    return inventory.where(F.col("sheet").isNull() | wanted)


def reconcile_sheets(inventory: DataFrame, choices: DataFrame, rule: SheetRule | None = None) -> DataFrame:
    """Sheets ticked per file.

    ``choices`` holds (path, sheet, checked). A sheet without a saved tick is
    on, a saved tick without a sheet is forgotten, and a rule with names takes
    the place of the ticks.
    """
    if rule is not None and rule.names:
        return apply_sheet_rule(inventory, rule)
    saved = choices.select("path", "sheet", F.col("checked").alias("_checked"))
    return (
        inventory.join(saved, ["path", "sheet"], "left")
        .where(F.coalesce("_checked", F.lit(True)))
        .select(*inventory.columns)
    )
