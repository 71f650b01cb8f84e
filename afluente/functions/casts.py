"""Lenient conversions: a value that does not fit its type becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from afluente import constants as C

# The text forms accepted for each type.
INTEGER_TEXT = r"^[+-]?[0-9]+\z"
FLOAT_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
BOOLEAN_TEXT = r"^(?i:true|false)\z"
DATE_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
DATETIME_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?\z"
DAY_FIRST_TEXT = r"^[0-9]{2}/[0-9]{2}/[0-9]{4}"

SPARK_TYPES = {
    C.TYPE_TEXT: T.StringType(),
    C.TYPE_INTEGER: T.LongType(),
    C.TYPE_FLOAT: T.DoubleType(),
    C.TYPE_DATE: T.DateType(),
    C.TYPE_BOOLEAN: T.BooleanType(),
}


def _guarded(value: Column, pattern: str, target: str) -> Column:
    return F.when(value.rlike(pattern), value.try_cast(target))


def text_to_integer(value: Column) -> Column:
    """Digits with an optional sign. A failing conversion is dear, so the form is tested first."""
    return _guarded(value, INTEGER_TEXT, "bigint")


def text_to_float(value: Column) -> Column:
    return _guarded(value, FLOAT_TEXT, "double")


def text_to_boolean(value: Column) -> Column:
    return _guarded(value, BOOLEAN_TEXT, "boolean")


def _day(value: Column, pattern: str, target: str) -> Column:
    """Year first, or day first with slashes; the usual form is tried first."""

    def part(start: int, length: int) -> Column:
        return F.substring(value, start, length)

    turned = F.concat(part(7, 4), F.lit("-"), part(4, 2), F.lit("-"), part(1, 2), F.substr(value, F.lit(11)))
    return F.when(value.rlike(pattern), value.try_cast(target)).when(
        value.rlike(DAY_FIRST_TEXT), _guarded(turned, pattern, target)
    )


def text_to_date(value: Column) -> Column:
    return _day(value, DATE_TEXT, "date")


def text_to_datetime(value: Column) -> Column:
    return _day(value, DATETIME_TEXT, "timestamp_ntz")


def fraction_to_text(value: Column) -> Column:
    """A floating number in plain decimal form where Spark would write an exponent, with one decimal at least."""
    size = F.abs(value)

    def plain(kind: str) -> Column:
        return F.regexp_replace(value.cast(kind).cast("string"), r"(\.[0-9]+?)0*\z", "$1")

    return (
        F.when((size >= 1e7) & (size < 1e27), plain("decimal(38,10)"))
        .when((size < 1e-3) & (size >= 1e-15), plain("decimal(38,36)"))
        .otherwise(value.cast("string"))
    )


def lenient_cast(value: Column, source: T.DataType, target: T.DataType) -> Column:
    """``value`` of type ``source`` as ``target``; null where it does not fit."""
    if source == target:
        return value
    if isinstance(source, T.StringType):
        if isinstance(target, T.IntegralType):
            return text_to_integer(value).try_cast(target)
        if isinstance(target, (T.DoubleType, T.FloatType)):
            return text_to_float(value).try_cast(target)
        if isinstance(target, T.DecimalType):
            return F.when(value.rlike(FLOAT_TEXT), value.try_cast(target))
        if isinstance(target, T.DateType):
            return text_to_date(value)
        if isinstance(target, (T.TimestampNTZType, T.TimestampType)):
            return text_to_datetime(value).try_cast(target)
        if isinstance(target, T.BooleanType):
            return text_to_boolean(value)
    if isinstance(target, T.StringType):
        return fraction_to_text(value) if isinstance(source, (T.DoubleType, T.FloatType)) else value.cast(target)
    return value.try_cast(target)


def typed_text(value: Column, label: str) -> Column:
    """A text column under a mapping type label; unknown labels leave it as text."""
    return lenient_cast(value, T.StringType(), SPARK_TYPES.get(label, T.StringType()))
