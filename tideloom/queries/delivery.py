"""Delivery at least once, records whose types drift, and the layout of what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import z_order
from ..operators.transform import CORRUPT_COLUMN
from ..plans import IngestConfig
from ..sinks import VersionedTable
from ..sources import list_objects, read_drifting, read_messages
from ..streaming import count_receives, drain_messages, drain_receipts
from ..workspace import fresh_path
from .fixtures import ORDERS_SQL, all_orders, table
from .registered import Query, register

QUERIES: dict[str, Query] = {}

# ---- receives and copies --------------------------------------------------------

_ALL_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, year FROM all_orders"
# Events arrive in three stretches of days, each a micro-batch of its own.
_STRETCHES = 3


def _stretch(at: str) -> Column:
    return F.floor((F.dayofmonth(at) - 1) / 11).cast("int")


@register(
    QUERIES,
    """WITH gaps AS (
        SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 12 HOURS, true) AS fresh FROM events
    ), lives AS (
        SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS life FROM gaps
    ), counted AS (
        SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, life ORDER BY ts, event_id) AS receives FROM lives
    )
    SELECT *, CASE WHEN receives <= 3 THEN 'deliver' WHEN receives = 4 THEN 'dead letter' ELSE 'gone' END AS action FROM counted""",
)
def receive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as receipts of a message for each user, which is forgotten twelve hours after the last one."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("received_at"))
    arrived, counted, progress = (fresh_path(spark, x) for x in ("receipts", "counted", "progress"))
    for stretch in range(_STRETCHES):
        events.where(_stretch("received_at") == stretch).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(events.schema).parquet(arrived)
        found = count_receives(stream, "user_id", "received_at", limit=3, keep="12 hours").select("event_id", "user_id", "receives", "action")
        found.writeStream.format("parquet").option("checkpointLocation", progress).trigger(availableNow=True).start(counted).awaitTermination()
    return spark.read.schema("event_id long, user_id long, receives long, action string").parquet(counted)


def _order_objects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str]:
    """The orders, one raw object for each priority, and a notification of each: ``message_id, body``."""
    orders = all_orders(spark, sf_dir)
    path = fresh_path(spark, "raw")
    named = orders.withColumn("arrival", F.col("o_orderpriority"))
    named.repartition("arrival").write.partitionBy("arrival").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    key = F.struct(F.url_encode("key").alias("key")).alias("object")
    record = F.struct(F.struct(F.struct(F.lit("x").alias("name")).alias("bucket"), key).alias("s3"))
    objects = list_objects(spark, path).where(F.col("key").endswith(".json"))
    number = F.regexp_extract(F.url_decode("key"), "arrival=([0-9])", 1).cast("int")
    return orders, objects.select(F.concat(F.lit("m"), number).alias("message_id"), number.alias("number"), F.to_json(F.struct(F.array(record).alias("Records"))).alias("body")), path


def _insert_config(spark: SparkSession, **options) -> IngestConfig:
    return IngestConfig(target_path=fresh_path(spark, "target"), record_key=("o_custkey",), ordering=("o_orderdate", "o_orderkey"), partitions=("year",), operation="insert", codec="zstd", **options)


@register(
    QUERIES,
    f"""{ORDERS_SQL} SELECT 'stored' AS what, o_orderpriority AS object, count(*) AS n FROM all_orders GROUP BY o_orderpriority
    UNION ALL SELECT DISTINCT 'dead letter', o_orderpriority, CAST(2 AS BIGINT) FROM all_orders WHERE o_orderpriority >= '2'""",
)
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications that come up to three times: each is applied once, and set aside the second time."""
    orders, messages, path = _order_objects(spark, sf_dir)
    config = _insert_config(spark)
    queue, progress = fresh_path(spark, "queue"), fresh_path(spark, "progress")
    schema = "message_id string, body string, received_at timestamp"
    for turn in range(1, 4):
        again = messages.where(F.col("number") >= turn).withColumn("received_at", F.timestamp_seconds(F.lit(turn * 60)))
        again.drop("number").write.mode("append").parquet(queue)
        stream = spark.readStream.schema(schema).parquet(queue)
        drain_receipts(stream, config, progress, path_template=f"{path}%.0s/%s", schema=orders.schema)
    dead = spark.read.json(f"{config.target_path}/_quarantine/dead_letters")
    key = F.url_decode(F.regexp_extract("body", '"key":"([^"]*)"', 1))
    letters = dead.select(F.lit("dead letter").alias("what"), F.url_decode(F.regexp_extract(key, "arrival=([^/]+)/", 1)).alias("object"), F.col("receives").alias("n"))
    stored = VersionedTable(spark, config.target_path, config.table).snapshot().groupBy(F.col("o_orderpriority").alias("object")).agg(F.count("*").alias("n"))
    return stored.select(F.lit("stored").alias("what"), "object", "n").unionByName(letters)


@register(QUERIES, f"{ORDERS_SQL} {_ALL_ORDERS}")
def notifications_delivered_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain inserts of objects whose notifications all come again in a later micro-batch."""
    orders, messages, path = _order_objects(spark, sf_dir)
    config = _insert_config(spark)
    queue, progress = fresh_path(spark, "queue"), fresh_path(spark, "progress")
    schema = "message_id string, body string, sent_at timestamp"
    for _ in range(2):
        messages.drop("number").withColumn("sent_at", F.timestamp_seconds(F.lit(60))).write.mode("append").parquet(queue)
        stream = spark.readStream.schema(schema).parquet(queue)
        drain_messages(stream, config, progress, message_id="message_id", within="1 hour", path_template=f"{path}%.0s/%s", schema=orders.schema)
    return VersionedTable(spark, config.target_path, config.table).snapshot()


@register(QUERIES, "SELECT CAST(3 AS BIGINT) AS batches, CAST(2 AS BIGINT) AS largest, count(*) AS n FROM orders")
def message_folder_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five notifications in a folder, two for each micro-batch, make three commits, over two runs."""
    orders, messages, path = _order_objects(spark, sf_dir)
    config = _insert_config(spark)
    queue, progress = fresh_path(spark, "queue"), fresh_path(spark, "progress")
    line = F.to_json(F.struct("message_id", F.lit("2024-01-01T00:00:00Z").alias("sent_at"), "body")).alias("value")
    for part in (F.col("number") <= 2, F.col("number") > 2):
        messages.where(part).select(line).write.mode("append").text(queue)
        drain_messages(read_messages(spark, queue, 2), config, progress, until_empty=True, path_template=f"{path}%.0s/%s", schema=orders.schema)
    held = VersionedTable(spark, config.target_path, config.table)
    commit = F.regexp_extract("_metadata.file_path", "_commit(?:=|%3D)([0-9]+)", 1).alias("batch")
    batches = spark.read.parquet(held.data_root).select(commit, "o_orderpriority").groupBy("batch").agg(F.countDistinct("o_orderpriority").alias("objects"), F.count("*").alias("n"))
    return batches.agg(F.count("*").alias("batches"), F.max("objects").alias("largest"), F.sum("n").alias("n"))


# ---- types that drift -------------------------------------------------------------

# The same field is a number, a text or an object, depending on the kind of event; errors are cut off.
_DRIFT = {
    "click": """concat('{"event_id": ', event_id, ', "ref": ', user_id, ', "score": ', event_id, ', "detail": {"k": ', user_id, '}}')""",
    "view": """concat('{"event_id": ', event_id, ', "ref": "u', user_id, '", "score": ', event_id, '.5, "tags": [', user_id, ', null]}')""",
    "purchase": """concat('{"event_id": ', event_id, ', "ref": {"u": ', user_id, '}, "detail": {"k": "n', user_id, '", "paid": true}}')""",
    "signup": """concat('{"event_id": ', event_id, ', "ref": null, "score": null, "tags": []}')""",
    "error": """concat('{"event_id": ', event_id, ', "ref": ')""",
}


@register(
    QUERIES,
    f"""SELECT CASE WHEN event_type <> 'error' THEN event_id END AS event_id,
        CASE event_type WHEN 'click' THEN CAST(user_id AS VARCHAR) WHEN 'view' THEN 'u' || user_id WHEN 'purchase' THEN '{{"u":' || user_id || '}}' END AS ref,
        CASE event_type WHEN 'click' THEN CAST(event_id AS DOUBLE) WHEN 'view' THEN event_id + CAST(0.5 AS DOUBLE) END AS score,
        CASE event_type WHEN 'click' THEN CAST(user_id AS VARCHAR) WHEN 'purchase' THEN 'n' || user_id END AS k, CASE event_type WHEN 'purchase' THEN true END AS paid,
        CASE event_type WHEN 'view' THEN CAST(2 AS INTEGER) WHEN 'signup' THEN CAST(0 AS INTEGER) END AS tags, CASE event_type WHEN 'view' THEN user_id END AS first_tag,
        CASE event_type WHEN 'error' THEN {_DRIFT['error']} END AS line FROM events""",
)
def drifting_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose fields change type with the kind of event, read in one pass."""
    cases = " ".join(f"WHEN '{kind}' THEN {line}" for kind, line in _DRIFT.items())
    path = fresh_path(spark, "lines")
    table(spark, sf_dir, "events").select(F.expr(f"CASE event_type {cases} END").alias("value")).write.text(path)
    return read_drifting(spark, [path]).select(
        "event_id", "ref", "score", F.col("detail.k").alias("k"), F.col("detail.paid").alias("paid"), F.when(F.col("tags").isNotNull(), F.size("tags")).alias("tags"),
        F.try_element_at("tags", F.lit(1)).alias("first_tag"), F.col(CORRUPT_COLUMN).alias("line"),
    )


# ---- layout -------------------------------------------------------------------------

_Z_BITS = 4


def _z_sql(columns: tuple[str, ...], bits: int) -> str:
    bins = 1 << bits
    bounds = " UNION ALL ".join(
        f"SELECT DISTINCT {i} AS c, epoch_us(CAST({c} AS TIMESTAMP)) AS bound FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) AS r, count(*) OVER () AS n FROM orders WHERE {c} IS NOT NULL) "
        f"WHERE r IN (SELECT CAST(ceil(n * b / {bins}.0) AS BIGINT) FROM range(1, {bins}) t(b))"
        if c == "o_orderdate"
        else f"SELECT DISTINCT {i} AS c, {c} AS bound FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) AS r, count(*) OVER () AS n FROM orders WHERE {c} IS NOT NULL) "
        f"WHERE r IN (SELECT CAST(ceil(n * b / {bins}.0) AS BIGINT) FROM range(1, {bins}) t(b))"
        for i, c in enumerate(columns)
    )
    own = ", ".join(f"(SELECT count(*) FROM bounds b WHERE b.c = {i} AND b.bound < {f'epoch_us(CAST({c} AS TIMESTAMP))' if c == 'o_orderdate' else c}) AS n{i}" for i, c in enumerate(columns))
    place = " + ".join(f"(((n{i} >> {bit}) & 1) << {bit * len(columns) + len(columns) - 1 - i})" for bit in range(bits) for i in range(len(columns)))
    return f"WITH bounds AS ({bounds}) SELECT o_orderkey, CAST({place} AS BIGINT) AS z FROM (SELECT o_orderkey, {own} FROM orders)"


@register(QUERIES, _z_sql(("o_custkey", "o_orderdate"), _Z_BITS))
def curve_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's place on a curve through customer and date, sixteen bins of equal rows for both."""
    return z_order(table(spark, sf_dir, "orders"), ("o_custkey", "o_orderdate"), bits=_Z_BITS).select("o_orderkey", "z")


@register(QUERIES, f"{ORDERS_SQL} {_ALL_ORDERS}")
def clustered_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bulk insert laid out by customer and date together."""
    config = _insert_config(spark, cluster_by=("o_custkey", "o_orderdate"))
    held = VersionedTable(spark, config.target_path, config.table)
    held.bulk_insert(all_orders(spark, sf_dir))
    return held.snapshot()
