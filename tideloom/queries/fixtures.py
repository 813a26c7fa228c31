"""Inputs of the queries, derived from the given tables.

Orders act as a keyed table: the key is the customer, the ordering the order
date (then the order number), the partition the year. Urgent and high priority
orders arrive as the batch, the others are the current table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyspec import KeySpec

ARRIVING = ("1-URGENT", "2-HIGH")

GLOBAL_COMMIT = KeySpec(("o_custkey",), ("o_orderdate", "o_orderkey"), ("year",), global_keys=True)
GLOBAL_EVENT = KeySpec(("o_custkey",), ("o_orderdate", "o_orderkey"), ("year",), global_keys=True, event_time=True)
LOCAL_COMMIT = KeySpec(("o_custkey",), ("o_orderdate", "o_orderkey"), ("year",))
LOCAL_EVENT = KeySpec(("o_custkey",), ("o_orderdate", "o_orderkey"), ("year",), event_time=True)

# The same inputs for SQL: all_orders, current_rows, incoming_rows, and each of
# them reduced to the latest row per customer (g_) or per customer and year (l_).
ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, year"


def latest(source: str, scope: str, order: str = "o_orderdate DESC, o_orderkey DESC") -> str:
    return (
        f"SELECT {ORDER_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY {order}) AS rn "
        f"FROM {source}) ranked WHERE rn = 1"
    )


ORDERS_SQL = f"""
WITH all_orders AS (SELECT *, CAST(extract(year FROM o_orderdate) AS INTEGER) AS year FROM orders),
current_rows AS (SELECT * FROM all_orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')),
incoming_rows AS (SELECT * FROM all_orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
g_current AS ({latest('current_rows', 'o_custkey')}),
g_incoming AS ({latest('incoming_rows', 'o_custkey')}),
l_current AS ({latest('current_rows', 'o_custkey, year')}),
l_incoming AS ({latest('incoming_rows', 'o_custkey, year')})
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))


def current_and_incoming(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = all_orders(spark, sf_dir)
    arriving = F.col("o_orderpriority").isin(*ARRIVING)
    return orders.where(~arriving), orders.where(arriving)
