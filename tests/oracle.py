"""Compare queries with their SQL: python -m tests.oracle SCALE [name …]"""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, bool):
        return value
    return value


def _sorted(rows):
    return sorted((tuple(_plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def difference(spark, connection, folder: str, name: str, build, sql: str) -> str | None:
    """None where both agree; otherwise what differs."""
    result = build(spark, folder)
    columns = sorted(result.columns)
    found = _sorted([tuple(r[c] for c in columns) for r in (row.asDict() for row in result.collect())])
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} but SQL has {sorted(names)}"
    place = [names.index(c) for c in columns]
    wanted = _sorted([tuple(r[i] for i in place) for r in cursor.fetchall()])
    if len(found) != len(wanted):
        return f"{len(found)} rows but SQL has {len(wanted)}"
    for mine, other in zip(found, wanted):
        if mine != other:
            return f"{str(mine)[:400]} but SQL has {str(other)[:400]}"
    if not found:
        return "no rows"
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    folder = f"/root/testdata/sf{sys.argv[1]}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    oracles = contract.oracle_sql()
    failed = 0
    for name, build in contract.queries().items():
        if name not in oracles or (sys.argv[2:] and name not in sys.argv[2:]):
            continue
        started = time.time()
        try:
            problem = difference(spark, connection, folder, name, build, oracles[name])
        except Exception as error:
            problem = "".join(traceback.format_exception_only(error))[:1500]
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok':5}{name:28}{time.time() - started:7.2f}s {problem or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
