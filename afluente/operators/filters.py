"""Filter rules compiled to one Spark predicate."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from afluente import constants as C
from afluente.functions.casts import lenient_cast
from afluente.functions.text import named


@dataclass(frozen=True)
class FilterRule:
    """One rule; ``value`` is text, or a pair of texts for a range."""

    column: str | None
    operator: str | None
    value: str | list[str] | tuple[str, str] | None = ""


@dataclass(frozen=True)
class IgnoredRule:
    rule: FilterRule
    reason: str


@dataclass(frozen=True)
class CompiledFilter:
    """``predicate`` is None when no rule applies."""

    predicate: Column | None
    ignored: tuple[IgnoredRule, ...]


# Rules that take rows out; all others let rows in.
_EXCLUDING = frozenset({C.NOT_EQUAL, C.NOT_CONTAINS})

_ON_NULLNESS: Mapping[str, Callable[[Column], Column]] = {
    C.IS_BLANK: lambda c: c.isNull(),
    C.NOT_BLANK: lambda c: c.isNotNull(),
}
_ON_ANY_TYPE: Mapping[str, Callable[[Column, Column], Column]] = {
    C.EQUAL: lambda c, v: c == v,
    C.NOT_EQUAL: lambda c, v: c != v,
    C.GREATER: lambda c, v: c > v,
    C.LESS: lambda c, v: c < v,
}
_ON_TEXT: Mapping[str, Callable[[Column, str], Column]] = {
    C.CONTAINS: lambda c, v: c.contains(v),
    C.NOT_CONTAINS: lambda c, v: ~c.contains(v),
    C.STARTS_WITH: lambda c, v: c.startswith(v),
    C.ENDS_WITH: lambda c, v: c.endswith(v),
}


def _literal(text: str, kind: T.DataType) -> Column:
    """A rule value in the type of its column; null where it does not parse."""
    return lenient_cast(F.lit(text.strip()), T.StringType(), kind)


def _compile_rule(rule: FilterRule, column: Column, kind: T.DataType) -> Column | str:
    """The rule as a predicate, or the reason why it is ignored."""
    operator, value = rule.operator, rule.value
    if operator is None or value is None:
        return "incomplete rule"
    if operator in _ON_NULLNESS:
        return _ON_NULLNESS[operator](column)
    if operator == C.BETWEEN:
        if isinstance(value, str) or len(value) != 2 or not all(v.strip() for v in value):
            return "a range needs two values"
        return column.between(*(_literal(v, kind) for v in value))
    if not isinstance(value, str) or not value.strip():
        return "no value"
    if operator in _ON_ANY_TYPE:
        return _ON_ANY_TYPE[operator](column, _literal(value, kind))
    if operator not in _ON_TEXT:
        return "unknown operator"
    if not isinstance(kind, T.StringType):
        return "text rule on a column that is not text"
    return _ON_TEXT[operator](column, value.strip())


def compile_filter(
    rules: Iterable[FilterRule],
    types: Mapping[str, T.DataType],
    present: Mapping[str, Column] | None = None,
) -> CompiledFilter:
    """Rules as one predicate.

    On one column, rules that let rows in are joined by OR and rules that take
    rows out by AND; both parts, and all columns, are joined by AND. A rule
    does nothing for a source that lacks its column: ``present`` tells per row
    whether the source has it.
    """
    ignored: list[IgnoredRule] = []
    letting_in: dict[str, list[Column]] = {}
    taking_out: dict[str, list[Column]] = {}
    for rule in rules:
        if not rule.column:
            ignored.append(IgnoredRule(rule, "no column"))
            continue
        if rule.column not in types:
            ignored.append(IgnoredRule(rule, "column not found"))
            continue
        compiled = _compile_rule(rule, named(rule.column), types[rule.column])
        if isinstance(compiled, str):
            ignored.append(IgnoredRule(rule, compiled))
            continue
        side = taking_out if rule.operator in _EXCLUDING else letting_in
        side.setdefault(rule.column, []).append(compiled)

    per_column = []
    for column in dict.fromkeys([*letting_in, *taking_out]):
        parts = []
        if column in letting_in:
            parts.append(reduce(or_, letting_in[column]))
        if column in taking_out:
            parts.append(reduce(and_, taking_out[column]))
        test = reduce(and_, parts)
        if present and column in present:
            test = ~present[column] | test
        per_column.append(test)
    return CompiledFilter(reduce(and_, per_column) if per_column else None, tuple(ignored))


def apply_filters(df: DataFrame, rules: Iterable[FilterRule]) -> DataFrame:
    compiled = compile_filter(rules, {f.name: f.dataType for f in df.schema})
    return df if compiled.predicate is None else df.where(compiled.predicate)
