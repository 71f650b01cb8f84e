"""Registry of queries and helpers that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from afluente.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_WRITTEN: dict[tuple[str, str, str], str] = {}


class Tables:
    """The sample tables of one scale; each attribute is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def written(self, name: str, write: Callable[[str], None]) -> str:
        """Files derived from the tables, written once per application into the shared folder."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _WRITTEN:
            place = f"{shared_folder(self.spark)}/{name}"
            write(place)
            _WRITTEN[key] = place
        return _WRITTEN[key]


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under ``name``."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
