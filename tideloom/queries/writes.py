"""Pre-combining and every keyed write operation, as plain DataFrame operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import (
    KeySpec,
    bulk_insert,
    delete_keys,
    drop_partitions,
    insert,
    insert_if_absent,
    merge_upsert,
    overwrite_partitions,
    precombine,
)
from .fixtures import (
    GLOBAL_COMMIT,
    GLOBAL_EVENT,
    LOCAL_COMMIT,
    LOCAL_EVENT,
    ORDER_COLUMNS,
    ORDERS_SQL,
    all_orders,
    current_and_incoming,
    latest,
    table,
)
from .registered import Query, register

QUERIES: dict[str, Query] = {}


@register(QUERIES, f"{ORDERS_SQL} {latest('all_orders', 'o_custkey')}")
def precombine_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return precombine(all_orders(spark, sf_dir), GLOBAL_COMMIT)


@register(QUERIES, f"{ORDERS_SQL} {latest('all_orders', 'o_custkey, year')}")
def precombine_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return precombine(all_orders(spark, sf_dir), LOCAL_COMMIT)


@register(
    QUERIES,
    f"""{ORDERS_SQL} {latest('all_orders', 'o_custkey',
        'o_orderdate DESC, o_orderkey DESC, o_orderpriority DESC, o_orderstatus DESC, o_totalprice DESC')}""",
)
def precombine_tie_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal order dates: the row content decides, column by column."""
    return precombine(all_orders(spark, sf_dir), replace(GLOBAL_COMMIT, ordering=("o_orderdate",)))


def _upsert(spark: SparkSession, sf_dir: str, spec: KeySpec) -> DataFrame:
    current, incoming = current_and_incoming(spark, sf_dir)
    return merge_upsert(precombine(current, spec), incoming, spec, unique_current=True)


@register(
    QUERIES,
    f"""{ORDERS_SQL}
    SELECT {ORDER_COLUMNS} FROM g_incoming
    UNION ALL SELECT {ORDER_COLUMNS} FROM g_current WHERE o_custkey NOT IN (SELECT o_custkey FROM g_incoming)""",
)
def upsert_commit_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upsert(spark, sf_dir, GLOBAL_COMMIT)


@register(QUERIES, f"{ORDERS_SQL} {latest('all_orders', 'o_custkey')}")
def upsert_event_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upsert(spark, sf_dir, GLOBAL_EVENT)


@register(
    QUERIES,
    f"""{ORDERS_SQL}
    SELECT {ORDER_COLUMNS} FROM l_incoming
    UNION ALL SELECT {ORDER_COLUMNS} FROM l_current c
    WHERE NOT EXISTS (SELECT 1 FROM l_incoming i WHERE i.o_custkey = c.o_custkey AND i.year = c.year)""",
)
def upsert_commit_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upsert(spark, sf_dir, LOCAL_COMMIT)


@register(QUERIES, f"{ORDERS_SQL} {latest('all_orders', 'o_custkey, year')}")
def upsert_event_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upsert(spark, sf_dir, LOCAL_EVENT)


@register(
    QUERIES,
    f"""{ORDERS_SQL},
    both_sides AS (
        SELECT *, 0 AS arrived FROM l_current UNION ALL SELECT *, 1 AS arrived FROM l_incoming
    ) {latest('both_sides', 'o_custkey, year', 'o_orderdate DESC, arrived DESC')}""",
)
def upsert_event_tie_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered by date alone: on equal dates the incoming row is stored."""
    current, incoming = current_and_incoming(spark, sf_dir)
    spec = replace(LOCAL_EVENT, ordering=("o_orderdate",))
    batch = precombine(incoming, LOCAL_EVENT)
    return merge_upsert(precombine(current, LOCAL_EVENT), batch, spec, unique_incoming=True)


@register(
    QUERIES,
    f"{ORDERS_SQL} SELECT {ORDER_COLUMNS} FROM l_current UNION ALL SELECT {ORDER_COLUMNS} FROM incoming_rows",
)
def insert_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, incoming = current_and_incoming(spark, sf_dir)
    return insert(precombine(current, LOCAL_COMMIT), incoming)


@register(QUERIES, f"{ORDERS_SQL} SELECT {ORDER_COLUMNS} FROM all_orders")
def bulk_insert_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bulk_insert(all_orders(spark, sf_dir), LOCAL_COMMIT)


@register(
    QUERIES,
    f"""{ORDERS_SQL} SELECT {ORDER_COLUMNS} FROM g_current
    WHERE o_custkey NOT IN (SELECT o_custkey FROM incoming_rows WHERE o_orderstatus = 'P')""",
    name="delete_keys",
)
def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a pending order in the batch are deleted."""
    current, incoming = current_and_incoming(spark, sf_dir)
    return delete_keys(precombine(current, GLOBAL_COMMIT), incoming.where("o_orderstatus = 'P'"), GLOBAL_COMMIT)


@register(
    QUERIES,
    f"""{ORDERS_SQL} SELECT {ORDER_COLUMNS} FROM l_incoming WHERE year >= 2000
    UNION ALL SELECT {ORDER_COLUMNS} FROM l_current
    WHERE year NOT IN (SELECT year FROM l_incoming WHERE year >= 2000)""",
)
def insert_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, incoming = current_and_incoming(spark, sf_dir)
    batch = precombine(incoming, LOCAL_COMMIT).where("year >= 2000")
    return overwrite_partitions(precombine(current, LOCAL_COMMIT), batch, ["year"])


@register(QUERIES, f"{ORDERS_SQL} SELECT {ORDER_COLUMNS} FROM l_current WHERE year NOT IN (1995, 1996)")
def delete_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, _ = current_and_incoming(spark, sf_dir)
    listed = all_orders(spark, sf_dir).where("year < 1997").select("year")
    return drop_partitions(precombine(current, LOCAL_COMMIT), listed, ["year"])


@register(
    QUERIES,
    f"""{ORDERS_SQL} SELECT {ORDER_COLUMNS} FROM g_current
    UNION ALL SELECT {ORDER_COLUMNS} FROM g_incoming WHERE o_custkey NOT IN (SELECT o_custkey FROM g_current)""",
    name="insert_if_absent",
)
def get_or_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, incoming = current_and_incoming(spark, sf_dir)
    return insert_if_absent(precombine(current, GLOBAL_COMMIT), incoming, GLOBAL_COMMIT)


_LINE_ORDER = ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
_LINES = KeySpec(("l_orderkey", "l_linenumber"), _LINE_ORDER, global_keys=True, event_time=True)
_LINE_COLUMNS = (
    "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus, l_shipdate"
)


@register(
    QUERIES,
    f"""SELECT {_LINE_COLUMNS} FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
            ORDER BY {', '.join(c + ' DESC' for c in _LINE_ORDER)}) AS rn FROM lineitem) r WHERE rn = 1""",
)
def composite_key_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two key columns; returned lines arrive as the batch."""
    lines = table(spark, sf_dir, "lineitem")
    returned = F.col("l_returnflag") == "R"
    return merge_upsert(precombine(lines.where(~returned), _LINES), lines.where(returned), _LINES, unique_current=True)


@register(
    QUERIES,
    f"""{ORDERS_SQL},
    evolved AS (SELECT *, o_orderstatus || '/' || o_orderpriority AS new_col FROM g_incoming)
    SELECT {ORDER_COLUMNS}, new_col FROM evolved
    UNION ALL SELECT {ORDER_COLUMNS}, NULL FROM g_current
    WHERE o_custkey NOT IN (SELECT o_custkey FROM evolved)""",
)
def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column the table does not have yet arrives with the batch."""
    current, incoming = current_and_incoming(spark, sf_dir)
    evolved = incoming.withColumn("new_col", F.concat_ws("/", "o_orderstatus", "o_orderpriority"))
    return merge_upsert(precombine(current, GLOBAL_COMMIT), evolved, GLOBAL_COMMIT)


# Three keys that each hold a third of all lines.
HOT = KeySpec(("l_returnflag",), ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"), global_keys=True)
LATEST_LINES_SQL = f"""
    SELECT {_LINE_COLUMNS} FROM (
        SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {', '.join(c + ' DESC' for c in HOT.ordering)}) AS rn
        FROM lineitem) r WHERE rn = 1"""


@register(QUERIES, LATEST_LINES_SQL)
def precombine_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return precombine(table(spark, sf_dir, "lineitem"), HOT)


@register(
    QUERIES,
    f"""SELECT {_LINE_COLUMNS} FROM lineitem WHERE l_returnflag <> 'R'
    UNION ALL SELECT * FROM ({LATEST_LINES_SQL}) h WHERE l_returnflag = 'R'""",
)
def upsert_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every current row of a key that holds a third of the table is replaced by one incoming row."""
    lines = table(spark, sf_dir, "lineitem")
    return merge_upsert(lines, lines.where("l_returnflag = 'R'"), replace(HOT, event_time=True))
