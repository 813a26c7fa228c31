"""How a query is written down."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None  # the same result for a plain SQL engine, where it can be said in SQL


def register(queries: dict[str, Query], sql: str | None = None, name: str | None = None):
    def note(run):
        queries[name or run.__name__] = Query(run, sql)
        return run

    return note
