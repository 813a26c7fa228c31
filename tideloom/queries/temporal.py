"""Rows in force at a time, times within intervals, and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import in_force, sql_transform, within
from .fixtures import table
from .registered import Query, register

QUERIES: dict[str, Query] = {}

_LINES_SQL = "lines AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line with its customer."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lines.join(orders, "l_orderkey")


@register(
    QUERIES,
    f"""WITH {_LINES_SQL}, days AS (
        SELECT o_custkey, o_orderdate, max(struct_pack(k := o_orderkey, p := o_orderpriority)) AS latest FROM orders GROUP BY ALL
    )
    SELECT l.l_orderkey, l.l_linenumber, l.l_shipdate, l.o_custkey, d.latest.k AS o_orderkey, d.latest.p AS o_orderpriority
    FROM lines l ASOF LEFT JOIN days d ON l.o_custkey = d.o_custkey AND l.l_shipdate >= d.o_orderdate""",
)
def orders_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer's latest order on the day that each line is shipped."""
    lines = _lines(spark, sf_dir).drop("l_quantity")
    history = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")
    return in_force(lines, history, ["o_custkey"], "l_shipdate", "o_orderdate", ["o_orderkey", "o_orderpriority"])


@register(
    QUERIES,
    f"""WITH {_LINES_SQL}
    SELECT o_orderkey, count(*) AS lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity
    FROM orders JOIN lines ON orders.o_custkey = lines.o_custkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 45 DAY
    GROUP BY o_orderkey""",
)
def lines_within_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shipped to a customer in the 45 days from each of their orders on."""
    lines = _lines(spark, sf_dir).select("o_custkey", "l_shipdate", "l_quantity")
    spans = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.expr("o_orderdate + INTERVAL 45 DAYS").alias("until"))
    found = within(lines, spans, ["o_custkey"], "l_shipdate", "o_orderdate", "until")
    return found.groupBy("o_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))


@register(
    QUERIES,
    """WITH gaps AS (
        SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOURS, true) AS fresh FROM events
    ), numbered AS (
        SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM gaps
    )
    SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS events, count(DISTINCT event_type) AS kinds
    FROM numbered GROUP BY user_id, n""",
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events with less than six hours between them, through the SQL transform."""
    statement = """SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS events, count(DISTINCT event_type) AS kinds
        FROM temp GROUP BY user_id, session_window(ts, '6 hours')"""
    return sql_transform(table(spark, sf_dir, "events"), statement)
