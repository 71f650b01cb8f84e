"""Lenient conversions of single values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from afluente.functions.casts import (
    text_to_boolean,
    text_to_date,
    text_to_datetime,
    text_to_float,
    text_to_integer,
)

DAY = dt.date(2024, 1, 2)
MOMENT = dt.datetime(2024, 1, 2)


@pytest.mark.parametrize(
    "convert,good,bad",
    [
        (
            text_to_integer,
            {"12": 12, "+7": 7, "-0012": -12, "9223372036854775807": 2**63 - 1},
            [" 12", "12 ", "12\n", "\t1", "12.0", "1e3", "1,5", "abc", "", "+", "-", "1-", "9223372036854775808", "1L", "\x7f1", "1\x00", "٣", "12\xa0"],
        ),
        (
            text_to_float,
            {"12": 12.0, "1.": 1.0, ".5": 0.5, "-1e3": -1000.0, "+2.5E-1": 0.25},
            [" 1.5", "1.5 ", "1,5", "1d", "1f", "nan", "inf", "0x1p3", ".", "1e", "1.5\n", ""],
        ),
        (
            text_to_date,
            {"2024-01-02": DAY, "02/01/2024": DAY},
            ["2024", "2024-1-2", "2024-02-30", "31/02/2024", "2024-01-02 ", " 2024-01-02", "2024-01-02T00:00:00", "02/01/2024 10:00", "2024/01/02", "x", ""],
        ),
        (
            text_to_datetime,
            {
                "2024-01-02": MOMENT,
                "02/01/2024": MOMENT,
                "2024-01-02 03:04": dt.datetime(2024, 1, 2, 3, 4),
                "2024-01-02T03:04:05.25": dt.datetime(2024, 1, 2, 3, 4, 5, 250000),
                "02/01/2024 03:04:05": dt.datetime(2024, 1, 2, 3, 4, 5),
            },
            ["2024", "2024-01-02 25:00", "2024-01-02 03", "2024-01-02 03:04 ", "03:04", "2024-01-02 03:04:05+01:00", ""],
        ),
        (text_to_boolean, {"true": True, "FALSE": False, "True": True}, ["t", "yes", "1", " true", "true\n", ""]),
    ],
)
def test_conversion(spark, convert, good, bad):
    texts = [*good, *bad]
    frame = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    found = {r["t"]: r["v"] for r in frame.select("t", convert(F.col("t")).alias("v")).collect()}
    assert found == {**good, **{t: None for t in bad}, None: None}
