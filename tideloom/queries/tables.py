"""The versioned table on shared storage: operations, views, versions and maintenance."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import KeySpec, expirable_by_commits, expirable_by_versions, small_file_candidates
from ..sinks import TableSpec, VersionedTable, register_external, register_table
from ..sinks.table import MERGE_ON_READ, SMALL_FILES_KEPT
from ..workspace import fresh_path
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
from .writes import HOT
from .writes import QUERIES as PLAIN

QUERIES: dict[str, Query] = {}


def _table(spark: SparkSession, key: KeySpec, **options) -> VersionedTable:
    options.setdefault("codec", "zstd")
    return VersionedTable(spark, fresh_path(spark, "table"), TableSpec(key, **options))


def _filled(spark: SparkSession, sf_dir: str, key: KeySpec, **options) -> tuple[VersionedTable, DataFrame]:
    """A table holding the current orders, and the batch."""
    current, incoming = current_and_incoming(spark, sf_dir)
    held = _table(spark, key, **options)
    held.upsert(current)
    return held, incoming


@register(QUERIES, PLAIN["upsert_commit_global"].sql)
def table_upsert_commit_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, incoming = _filled(spark, sf_dir, GLOBAL_COMMIT)
    held.upsert(incoming)
    return held.snapshot()


@register(QUERIES, PLAIN["upsert_event_global"].sql)
def table_upsert_event_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, incoming = _filled(spark, sf_dir, GLOBAL_EVENT)
    held.upsert(incoming)
    return held.snapshot()


@register(QUERIES, PLAIN["upsert_commit_local"].sql)
def table_upsert_commit_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, incoming = _filled(spark, sf_dir, LOCAL_COMMIT)
    held.upsert(incoming)
    return held.snapshot()


@register(QUERIES, PLAIN["upsert_event_local"].sql)
def table_upsert_event_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, incoming = _filled(spark, sf_dir, LOCAL_EVENT)
    held.upsert(incoming)
    return held.snapshot()


@register(QUERIES, PLAIN["upsert_event_global"].sql)
def table_unpartitioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, incoming = _filled(spark, sf_dir, replace(GLOBAL_EVENT, parts=()))
    held.upsert(incoming)
    return held.snapshot()


@register(QUERIES, PLAIN["upsert_hot_keys"].sql)
def table_upsert_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    held = _table(spark, replace(HOT, parts=("l_linestatus",)))
    held.insert(lines)
    held.upsert(lines.where("l_returnflag = 'R'"))
    return held.snapshot()


@register(QUERIES, PLAIN["insert_append"].sql)
def table_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, incoming = _filled(spark, sf_dir, LOCAL_COMMIT)
    held.insert(incoming)
    return held.snapshot()


@register(QUERIES, PLAIN["insert_append"].sql)
def table_bulk_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, incoming = _filled(spark, sf_dir, LOCAL_COMMIT)
    held.bulk_insert(incoming)
    return held.snapshot()


@register(QUERIES, PLAIN["delete_keys"].sql)
def table_delete_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, incoming = _filled(spark, sf_dir, GLOBAL_COMMIT)
    held.delete_keys(incoming.where("o_orderstatus = 'P'"))
    return held.snapshot()


@register(QUERIES, PLAIN["insert_if_absent"].sql)
def table_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, incoming = _filled(spark, sf_dir, GLOBAL_COMMIT)
    held.insert_if_absent(incoming)
    return held.snapshot()


@register(
    QUERIES,
    f"""{ORDERS_SQL} SELECT {ORDER_COLUMNS} FROM incoming_rows WHERE year >= 2000
    UNION ALL SELECT {ORDER_COLUMNS} FROM l_current
    WHERE year NOT IN (SELECT year FROM incoming_rows WHERE year >= 2000)""",
)
def table_insert_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, incoming = _filled(spark, sf_dir, LOCAL_COMMIT)
    held.insert_overwrite(incoming.where("year >= 2000"))
    return held.snapshot()


@register(QUERIES, f"{ORDERS_SQL} SELECT {ORDER_COLUMNS} FROM incoming_rows")
def overwrite_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, incoming = _filled(spark, sf_dir, LOCAL_COMMIT)
    held.insert_overwrite_table(incoming)
    return held.snapshot()


@register(QUERIES, PLAIN["delete_partition"].sql)
def table_delete_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, _ = _filled(spark, sf_dir, LOCAL_COMMIT)
    held.delete_partition(all_orders(spark, sf_dir).where("year < 1997").select("year"))
    return held.snapshot()


@register(QUERIES, PLAIN["schema_evolution"].sql)
def table_schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, incoming = _filled(spark, sf_dir, GLOBAL_COMMIT)
    held.upsert(incoming.withColumn("new_col", F.concat_ws("/", "o_orderstatus", "o_orderpriority")))
    return held.snapshot()


@register(QUERIES, f"{ORDERS_SQL} SELECT {ORDER_COLUMNS} FROM g_current")
def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version before the upsert."""
    held, incoming = _filled(spark, sf_dir, GLOBAL_COMMIT)
    held.upsert(incoming)
    return held.snapshot(as_of=1)


@register(QUERIES, f"{ORDERS_SQL} SELECT {ORDER_COLUMNS} FROM incoming_rows")
def changes_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended after the first commit, read from folded manifests."""
    held, incoming = _filled(spark, sf_dir, LOCAL_COMMIT)
    held.insert(incoming)
    held.fold_manifests(at_least=1)
    return held.changes_since(1)


def _logged(spark: SparkSession, sf_dir: str, key: KeySpec) -> VersionedTable:
    """A merge-on-read table with one change-log commit per priority."""
    held, incoming = _filled(spark, sf_dir, key, table_type=MERGE_ON_READ)
    held.upsert(incoming.where("o_orderpriority = '1-URGENT'"))
    held.upsert(incoming.where("o_orderpriority = '2-HIGH'"))
    return held


@register(QUERIES, PLAIN["upsert_event_global"].sql)
def mor_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logged(spark, sf_dir, GLOBAL_EVENT).snapshot()


@register(
    QUERIES,
    f"""{ORDERS_SQL},
    second AS ({latest("(SELECT * FROM incoming_rows WHERE o_orderpriority = '2-HIGH')", 'o_custkey, year')}),
    first AS ({latest("(SELECT * FROM incoming_rows WHERE o_orderpriority = '1-URGENT')", 'o_custkey, year')}),
    changes AS (
        SELECT * FROM second UNION ALL SELECT * FROM first f
        WHERE NOT EXISTS (SELECT 1 FROM second s WHERE s.o_custkey = f.o_custkey AND s.year = f.year)
    )
    SELECT {ORDER_COLUMNS} FROM changes UNION ALL SELECT {ORDER_COLUMNS} FROM l_current c
    WHERE NOT EXISTS (SELECT 1 FROM changes s WHERE s.o_custkey = c.o_custkey AND s.year = c.year)""",
)
def mor_snapshot_commit_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logged(spark, sf_dir, LOCAL_COMMIT).snapshot()


@register(QUERIES, f"{ORDERS_SQL} SELECT {ORDER_COLUMNS} FROM g_current")
def mor_read_optimized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logged(spark, sf_dir, GLOBAL_EVENT).read_optimized()


@register(QUERIES, PLAIN["upsert_event_global"].sql)
def mor_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _logged(spark, sf_dir, GLOBAL_EVENT)
    held.compact_log()
    return held.read_optimized()


@register(QUERIES, PLAIN["upsert_event_global"].sql)
def mor_catalog_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _logged(spark, sf_dir, GLOBAL_EVENT)
    _, merged = register_table(held, "tideloom_db", "orders_log")
    return spark.table(merged)


@register(QUERIES, PLAIN["upsert_commit_local"].sql)
def catalog_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, incoming = _filled(spark, sf_dir, LOCAL_COMMIT)
    held.upsert(incoming)
    (view,) = register_table(held, "tideloom_db", "orders_current")
    return spark.table(view)


@register(QUERIES, f"{ORDERS_SQL} SELECT {ORDER_COLUMNS} FROM all_orders")
def external_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain hive-style folder, registered with its partitions."""
    orders = all_orders(spark, sf_dir)
    path = fresh_path(spark, "plain")
    orders.write.partitionBy("year").option("compression", "gzip").parquet(path)
    return spark.table(register_external(spark, "tideloom_db", "orders_plain", path, orders.schema, ["year"]))


# Retention over a listing derived from the orders: a priority is a partition,
# each month with orders of that priority is a commit replacing its file.
_LISTING_SQL = """
WITH versions AS (
    SELECT DISTINCT o_orderpriority AS part_key,
           CAST(extract(year FROM o_orderdate) * 100 + extract(month FROM o_orderdate) AS BIGINT) AS added
    FROM orders
),
files AS (SELECT *, lead(added) OVER (PARTITION BY part_key ORDER BY added) AS removed FROM versions)
"""


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long")
    touched = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("part_key"), month.alias("added"))
    touched.distinct().createOrReplaceTempView("touched_partitions")
    return spark.sql(
        "SELECT part_key, added, lead(added) OVER (PARTITION BY part_key ORDER BY added) AS removed "
        "FROM touched_partitions"
    )


@register(
    QUERIES,
    f"""{_LISTING_SQL} SELECT part_key, added, removed FROM (
        SELECT *, row_number() OVER (PARTITION BY part_key ORDER BY added DESC) AS rn FROM files) r WHERE rn > 3""",
)
def expire_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expirable_by_versions(_listing(spark, sf_dir), retained=3)


@register(
    QUERIES,
    f"""{_LISTING_SQL} SELECT part_key, added, removed FROM files
    WHERE removed <= (SELECT min(added) FROM (SELECT DISTINCT added FROM files ORDER BY added DESC LIMIT 5) c)""",
)
def expire_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _listing(spark, sf_dir)
    return expirable_by_commits(files, files.select(F.col("added").alias("seq")), retained=5)


@register(QUERIES, PLAIN["upsert_event_local"].sql)
def table_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removing old versions leaves the newest one as it was."""
    held, incoming = _filled(spark, sf_dir, LOCAL_EVENT)
    held.upsert(incoming.where("o_orderpriority = '1-URGENT'"))
    held.upsert(incoming.where("o_orderpriority = '2-HIGH'"))
    held.expire(versions=1)
    return held.snapshot()


_SIZES_SQL = """
WITH files AS (
    SELECT o_orderpriority || '/' || o_orderstatus AS part_key,
           CAST(extract(year FROM o_orderdate) * 100 + extract(month FROM o_orderdate) AS BIGINT) AS file,
           CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes
    FROM orders GROUP BY 1, 2
)
"""


@register(
    QUERIES,
    f"""{_SIZES_SQL}, small AS (SELECT * FROM files WHERE bytes < 4000000)
    SELECT part_key, file, bytes FROM (SELECT *, count(*) OVER (PARTITION BY part_key) AS n FROM small) s
    WHERE n > 1""",
    name="small_file_candidates",
)
def small_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month of orders stands for a file, its total price for the size."""
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long")
    listing = (
        table(spark, sf_dir, "orders")
        .groupBy(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("part_key"), month.alias("file"))
        .agg(F.sum(F.round("o_totalprice").cast("long")).alias("bytes"))
    )
    return small_file_candidates(listing, limit_bytes=4_000_000)


@register(
    QUERIES,
    f"{ORDERS_SQL} SELECT year, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, "
    "CAST(1 AS BIGINT) AS files FROM all_orders GROUP BY year",
)
def compact_small_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three appends per partition packed into one file each."""
    orders = all_orders(spark, sf_dir)
    held = _table(spark, LOCAL_COMMIT)
    for status in ("F", "O", "P"):
        held.insert(orders.where(F.col("o_orderstatus") == status))
    held.compact_small_files()
    live = held.file_lives().where(F.col("removed").isNull())
    files = live.groupBy(F.get_json_object("part_key", "$.year").cast("int").alias("file_year")).agg(
        F.count("*").alias("files")
    )
    totals = held.snapshot().groupBy("year").agg(
        F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")
    )
    return totals.join(files, F.col("year") == F.col("file_year")).select("year", "n", "keys", "files")


@register(
    QUERIES,
    """SELECT event_id, date_trunc('day', ts) + to_microseconds(event_id % 3) AS at,
        CASE WHEN event_id % 3 = 1 THEN 'new' ELSE event_type END AS event_type FROM events WHERE event_id % 3 <> 2""",
)
def overwrite_timestamp_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions a microsecond apart: one of each three is overwritten, one dropped, one stays."""
    part = F.expr("date_trunc('DAY', ts)").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, cast((event_id % 3) * 0.000001 AS decimal(18, 6)))")
    events = table(spark, sf_dir, "events").select("event_id", part.alias("at"), "event_type")
    held = _table(spark, KeySpec(("event_id",), (), ("at",)))
    held.insert(events)
    held.insert_overwrite(events.where("event_id % 3 = 1").withColumn("event_type", F.lit("new")))
    held.delete_partition(events.where("event_id % 3 = 2").select("at").distinct())
    return held.snapshot()


@register(
    QUERIES,
    f"""{ORDERS_SQL}, keys AS (SELECT DISTINCT o_custkey, year FROM all_orders)
    SELECT year, count(*) AS n, true AS bounded FROM keys GROUP BY year""",
)
def upsert_series_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in seven batches: the files of a partition stay few."""
    orders = all_orders(spark, sf_dir)
    held = _table(spark, LOCAL_COMMIT)
    for batch in range(7):
        held.upsert(orders.where(F.pmod(F.col("o_orderkey"), F.lit(7)) == batch))
    live = held.file_lives().where(F.col("removed").isNull())
    files = live.groupBy(F.get_json_object("part_key", "$.year").cast("int").alias("file_year")).agg(F.count("*").alias("files"))
    rows = held.snapshot().groupBy("year").agg(F.count("*").alias("n"))
    return rows.join(files, F.col("year") == F.col("file_year")).select("year", "n", (F.col("files") <= SMALL_FILES_KEPT).alias("bounded"))


@register(
    QUERIES,
    f"{ORDERS_SQL} SELECT year, CAST(1 AS BIGINT) AS live, CAST(2 AS BIGINT) AS expired, count(*) AS n FROM all_orders GROUP BY year",
)
def expired_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of every partition, of which one is retained."""
    orders = all_orders(spark, sf_dir)
    held = _table(spark, LOCAL_COMMIT)
    for _ in range(3):
        held.insert_overwrite(orders)
    held.expire(versions=1)
    year = F.get_json_object("part_key", "$.year").cast("int").alias("file_year")
    files = held.file_lives().groupBy(year).agg(F.count_if(F.col("removed").isNull()).alias("live"), F.count("expired").alias("expired"))
    rows = held.snapshot().groupBy("year").agg(F.count("*").alias("n"))
    return rows.join(files, F.col("year") == F.col("file_year")).select("year", "live", "expired", "n")
