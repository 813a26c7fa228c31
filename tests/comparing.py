"""Comparing a Spark result with the result of the query's SQL counterpart."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(spark_result: DataFrame, connection, sql: str) -> str | None:
    cursor = connection.execute(sql)
    theirs_columns = [d[0] for d in cursor.description]
    theirs = rows_of(theirs_columns, cursor.fetchall())
    ours_columns = spark_result.columns
    if sorted(ours_columns) != sorted(theirs_columns):
        return f"columns {sorted(ours_columns)} vs {sorted(theirs_columns)}"
    ours = rows_of(ours_columns, spark_result.collect())
    if ours != theirs:
        extra, lacking = ours - theirs, theirs - ours
        return (
            f"{sum(ours.values())} vs {sum(theirs.values())} rows; "
            f"only ours {list(extra.items())[:3]}; only theirs {list(lacking.items())[:3]}"
        )
    return None
