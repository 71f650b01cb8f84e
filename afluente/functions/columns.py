"""Control over how often Spark works out a column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores behind it as it takes to differ from all ``taken`` names in any case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are worked out once per row.

    The optimizer copies the definition of a plain column into every filter and
    nested function that uses it. It does not look through a generator, and
    the single-row one used here costs no shuffle.
    """
    fields = [column.alias(name) for name, column in columns.items()]
    return df.select("*", F.inline(F.array(F.struct(*fields))))
