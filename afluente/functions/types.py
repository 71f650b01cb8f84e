"""The common type of one column that several inputs hold in different types."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _holds(types: set[T.DataType], *classes: type) -> bool:
    return any(isinstance(t, classes) for t in types)


def common_type(types: Iterable[T.DataType]) -> T.DataType | None:
    """Widest type that keeps every input; None where the inputs are left alone.

    Text absorbs everything, kinds that do not mix fall back to text, floats
    absorb integers, and a column that is null everywhere becomes text because
    not every sink can store an untyped column.
    """
    types = set(types)
    text = _holds(types, T.StringType, T.CharType, T.VarcharType)
    temporal = _holds(types, *_TEMPORAL)
    integer = _holds(types, T.IntegralType)
    fraction = _holds(types, T.FractionalType)
    boolean = _holds(types, T.BooleanType)
    kinds = sum((temporal, integer or fraction, boolean))

    if text or kinds > 1:
        return T.StringType()
    if fraction:
        return T.DoubleType()
    if integer:
        return T.LongType()
    if temporal:
        for wide in (T.TimestampType, T.TimestampNTZType):
            if _holds(types, wide):
                return wide()
        return T.DateType()
    if boolean:
        return T.BooleanType()
    if types == {T.NullType()}:
        return T.StringType()
    return None
