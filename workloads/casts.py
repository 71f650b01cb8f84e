"""Lenient conversions of messy text made from orders."""

from pyspark.sql import functions as F

from afluente import constants as C
from afluente.functions.casts import typed_text
from workloads.registry import query

# The same text in both engines: good values, and values that look convertible but are not.
NUMBERS = """CASE o_orderkey % 11
    WHEN 0 THEN CAST(o_custkey AS STRING)
    WHEN 1 THEN ' ' || CAST(o_custkey AS STRING) || ' '
    WHEN 2 THEN CAST(o_custkey AS STRING) || '.5'
    WHEN 3 THEN '-' || CAST(o_custkey AS STRING)
    WHEN 4 THEN '+' || CAST(o_custkey AS STRING)
    WHEN 5 THEN CAST(o_custkey AS STRING) || 'e2'
    WHEN 6 THEN CAST(o_custkey AS STRING) || ',5'
    WHEN 7 THEN CAST(o_custkey AS STRING) || 'd'
    WHEN 8 THEN '99999999999999999999'
    WHEN 9 THEN '.' || CAST(o_custkey AS STRING)
    ELSE NULL END"""
DAYS = """CASE o_orderkey % 8
    WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
    WHEN 1 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 9, 2) || '/' ||
                substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 6, 2) || '/' ||
                substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4)
    WHEN 2 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4)
    WHEN 3 THEN '1995-02-30'
    WHEN 4 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || ' '
    WHEN 5 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 8) || '1'
    WHEN 6 THEN 'ontem'
    ELSE NULL END"""
FLAGS = """CASE o_orderkey % 8
    WHEN 0 THEN 'true' WHEN 1 THEN 'FALSE' WHEN 2 THEN 'True' WHEN 3 THEN 't'
    WHEN 4 THEN 'yes' WHEN 5 THEN '1' WHEN 6 THEN ' true' ELSE NULL END"""

INTEGER_SQL = "CASE WHEN regexp_full_match({0}, '[+-]?[0-9]+') THEN TRY_CAST({0} AS BIGINT) END"
FLOAT_SQL = (
    r"CASE WHEN regexp_full_match({0}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') "
    "THEN TRY_CAST({0} AS DOUBLE) END"
)
_ISO = r"regexp_replace({0}, '^([0-9]{{2}})/([0-9]{{2}})/([0-9]{{4}})', '\3-\2-\1')"
DATE_SQL = f"CASE WHEN regexp_full_match({_ISO}, '[0-9]{{{{4}}}}-[0-9]{{{{2}}}}-[0-9]{{{{2}}}}') THEN TRY_CAST({_ISO} AS DATE) END"
DATETIME_SQL = (
    f"CASE WHEN regexp_full_match({_ISO}, "
    r"'[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}(\.[0-9]{{1,6}})?)?)?') "
    f"THEN TRY_CAST({_ISO} AS TIMESTAMP) END"
)
BOOLEAN_SQL = "CASE WHEN lower({0}) = 'true' THEN true WHEN lower({0}) = 'false' THEN false END"


def _oracle(text: str, conversion: str) -> str:
    return f"SELECT o_orderkey, texto, {conversion.format('texto')} AS valor FROM (SELECT o_orderkey, {text} AS texto FROM orders)"


def _converted(t, text, label):
    messy = t.orders.select("o_orderkey", F.expr(text).alias("texto"))
    return messy.withColumn("valor", typed_text(F.col("texto"), label))


@query("cast_integer", _oracle(NUMBERS, INTEGER_SQL))
def _(t):
    return _converted(t, NUMBERS, C.TYPE_INTEGER)


@query("cast_float", _oracle(NUMBERS, FLOAT_SQL))
def _(t):
    return _converted(t, NUMBERS, C.TYPE_FLOAT)


@query("cast_date", _oracle(DAYS, DATE_SQL))
def _(t):
    return _converted(t, DAYS, C.TYPE_DATE)


@query("cast_boolean", _oracle(FLAGS, BOOLEAN_SQL))
def _(t):
    return _converted(t, FLAGS, C.TYPE_BOOLEAN)


@query("cast_string", _oracle(NUMBERS, "{0}"))
def _(t):
    return _converted(t, NUMBERS, C.TYPE_TEXT)
