"""Sources, notifications, cleaning, transforms and whole ingestion runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import add_date_parts, bucket_of, sanitize_columns
from ..operators import expand_messages, filter_events, precombine, preview, split_valid, sql_transform
from ..operators.transform import CORRUPT_COLUMN, REASON_COLUMN
from ..plans import IngestConfig, ingest_batch
from ..plans.config import EVENT_TIME, GLOBAL_INDEX
from ..operators.keyspec import KeySpec
from ..sinks import VersionedTable, write_objects
from ..sources import list_objects, read_batch, with_provenance
from ..streaming import drain_files, drain_messages
from ..workspace import fresh_path, setting
from .fixtures import ORDERS_SQL, all_orders, latest, table
from .registered import Query, register

QUERIES: dict[str, Query] = {}

# ---- cleaning and transforming ------------------------------------------------

DATE_PARTS_QUERY = (
    "SELECT *, extract(year FROM ts) AS year, extract(month FROM ts) AS month, extract(day FROM ts) AS day FROM temp;"
)
_EVENT_COLUMNS = "event_id, ts, user_id, event_type, value, props"
_EVENT_DATES = (
    "CAST(extract(year FROM ts) AS INTEGER) AS year, CAST(extract(month FROM ts) AS INTEGER) AS month, "
    "CAST(extract(day FROM ts) AS INTEGER) AS day"
)


def _dollar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumnsRenamed(
        {"event_type": "$event_type", "value": "val$ue", "user_id": "user_id$"}
    )


@register(QUERIES, f"SELECT {_EVENT_COLUMNS} FROM events", name="sanitize_columns")
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitize_columns(_dollar_events(spark, sf_dir))


@register(QUERIES, f"SELECT {_EVENT_COLUMNS}, {_EVENT_DATES} FROM events")
def transform_date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_transform(sanitize_columns(_dollar_events(spark, sf_dir)), DATE_PARTS_QUERY, required=("user_id", "ts"))


@register(QUERIES, f"SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, {_EVENT_DATES} FROM events")
def date_parts_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date parts of an ISO text, as raw records carry it."""
    text = table(spark, sf_dir, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts")
    )
    return add_date_parts(text, "ts")


@register(
    QUERIES,
    f"""SELECT {_EVENT_COLUMNS}, {_EVENT_DATES} FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) r WHERE rn = 1""",
)
def latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean names, derive the partition columns, keep each user's latest event."""
    shaped = sql_transform(sanitize_columns(_dollar_events(spark, sf_dir)), DATE_PARTS_QUERY)
    return precombine(shaped, KeySpec(("user_id",), ("ts",), ("year", "month"), global_keys=True))


@register(QUERIES, f"SELECT {_EVENT_COLUMNS} FROM events ORDER BY event_id LIMIT 20")
def batch_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty rows of an ordered batch."""
    return preview(table(spark, sf_dir, "events").orderBy("event_id"), 20)


# ---- notifications ------------------------------------------------------------

# One message per ten documents, one record per document. French documents
# were removed rather than created; keys have a blank, which arrives encoded.
_DOCUMENT_OBJECTS_SQL = """
SELECT CAST(doc_id // 10 AS BIGINT) AS message_id,
       CASE WHEN lang = 'fr' THEN 'ObjectRemoved:Delete' ELSE 'ObjectCreated:Put' END AS event_name,
       'bkt' AS bucket,
       'raw/' || source || '/' || lang || ' ' || doc_id || '.json' AS key,
       's3://bkt/raw/' || source || '/' || lang || ' ' || doc_id || '.json' AS path
FROM documents
"""


def _document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(
        F.lit("raw/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("+"), F.col("doc_id").cast("string"),
        F.lit(".json"),
    )
    event = F.when(F.col("lang") == "fr", "ObjectRemoved:Delete").otherwise("ObjectCreated:Put")
    record = F.struct(
        event.alias("eventName"),
        F.struct(
            F.struct(F.lit("bkt").alias("name")).alias("bucket"), F.struct(name.alias("key")).alias("object")
        ).alias("s3"),
    )
    return (
        table(spark, sf_dir, "documents")
        .groupBy(F.floor(F.col("doc_id") / 10).cast("long").alias("message_id"))
        .agg(F.to_json(F.struct(F.collect_list(record).alias("Records"))).alias("body"))
    )


@register(QUERIES, _DOCUMENT_OBJECTS_SQL)
def expand_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, _ = expand_messages(_document_messages(spark, sf_dir))
    return objects


@register(
    QUERIES,
    f"SELECT * FROM ({_DOCUMENT_OBJECTS_SQL}) o WHERE event_name LIKE 'ObjectCreated:%' AND key LIKE 'raw/src1/%'",
    name="filter_events",
)
def filter_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, _ = expand_messages(_document_messages(spark, sf_dir))
    return filter_events(objects, prefix="raw/src1/")


_BODIES_SQL = """
CASE lang WHEN 'en' THEN text
          WHEN 'de' THEN '{"Event":"s3:TestEvent","Bucket":"bkt"}'
          WHEN 'es' THEN '{"Records":[{"s3":{"bucket":{"name":"bkt"},"object":{}}}]}'
          ELSE '{"Records":[{"s3":{"bucket":{"name":"bkt"},"object":{"key":"k"}}}]}' END
"""


@register(
    QUERIES,
    f"""SELECT doc_id, {_BODIES_SQL} AS body,
        CASE lang WHEN 'en' THEN 'not json' WHEN 'de' THEN 'no records' ELSE 'incomplete record' END AS reason
        FROM documents WHERE lang IN ('en', 'de', 'es')""",
)
def reject_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that name no object: prose, a test event, a record without a key."""
    body = F.expr(_BODIES_SQL.replace("\n", " "))
    _, rejected = expand_messages(table(spark, sf_dir, "documents").select("doc_id", body.alias("body")))
    return rejected


@register(
    QUERIES,
    """SELECT page_id, regexp_extract('s3' || substr(url, strpos(url, '://')), '^s3://([^/]+)/', 1) AS bucket,
              regexp_extract(url, '^https?://([^/]+)/', 1) AS host FROM pages""",
)
def split_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    as_object = F.concat(F.lit("s3"), F.expr("substring(url, locate('://', url))"))
    return pages.select(
        "page_id", bucket_of(as_object).alias("bucket"), bucket_of(F.col("url"), r"^https?://([^/]+)/").alias("host")
    )


# ---- file sources ---------------------------------------------------------------

_NTZ = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
# Files a writing task keeps open; rows of more folders than that are sorted as usual.
_OPEN_FILES = 32
# Tasks that write an object for each row.
_OBJECT_TASKS = 64


def _write_json(df: DataFrame, spark: SparkSession, folders: str) -> str:
    """Raw files in one sub-folder per value of a column, which stays in the records."""
    path = fresh_path(spark, "raw")
    # With a file open for each folder, a task need not sort its rows by folder first.
    with setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(_OPEN_FILES)):
        df.withColumn("arrival", F.col(folders)).write.partitionBy("arrival").option(
            "timestampNTZFormat", _NTZ
        ).json(path)
    return path


@register(QUERIES, f"SELECT {_EVENT_COLUMNS} FROM events")
def read_json_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    path = _write_json(events, spark, "event_type")
    return read_batch(spark, [path, path], "json", events.schema).drop(CORRUPT_COLUMN)


@register(QUERIES, "SELECT event_id, user_id, event_type, value, props FROM events")
def read_json_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    path = _write_json(events, spark, "event_type")
    return read_batch(spark, [path]).select("event_id", "user_id", "event_type", "value", "props")


@register(QUERIES, "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, value FROM events")
def read_json_inferred_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a schema a time stays the text it is."""
    path = _write_json(table(spark, sf_dir, "events"), spark, "event_type")
    return read_batch(spark, [path]).select("event_id", "ts", "value")


@register(QUERIES, f"SELECT {_EVENT_COLUMNS} FROM events")
def read_parquet_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "raw")
    events = table(spark, sf_dir, "events")
    events.withColumn("arrival", F.col("event_type")).write.partitionBy("arrival").parquet(path)
    return read_batch(spark, [path], "parquet")


@register(QUERIES, "SELECT event_id, event_type, event_type AS folder FROM events")
def row_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder of the file each row came from."""
    events = table(spark, sf_dir, "events")
    path = _write_json(events, spark, "event_type")
    rows = with_provenance(read_batch(spark, [path], "json", events.schema))
    return rows.select(
        "event_id", "event_type", F.regexp_extract("_source_path", "arrival=([^/]+)/", 1).alias("folder")
    )


@register(
    QUERIES,
    "SELECT DISTINCT 'arrival=' || source AS folder, source LIKE 'src1%' AS has_prefix FROM documents",
    name="list_objects",
)
def object_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders found by listing every object, and by listing those below a prefix."""
    path = _write_json(table(spark, sf_dir, "documents"), spark, "source")
    folder = F.element_at(F.split("key", "/"), 1).alias("folder")
    json_files = F.col("key").endswith(".json")
    found = list_objects(spark, path).where(json_files).select(folder).distinct()
    below = list_objects(spark, path, "arrival=src1").where(json_files).select(folder.alias("listed")).distinct()
    return found.join(below, F.col("folder") == F.col("listed"), "left").select(
        "folder", F.col("listed").isNotNull().alias("has_prefix")
    )


@register(
    QUERIES,
    """SELECT DISTINCT 'arrival=' || source || '/value=' || doc_id AS folder, source LIKE 'src1%' AS has_prefix, CAST(1 AS BIGINT) AS objects
    FROM documents""",
)
def list_object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of every object, and of every object below a prefix; each document is an object of its own."""
    path = fresh_path(spark, "raw")
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("arrival"), F.col("doc_id").alias("value"), "doc_id")
    # A number of tasks of its own: objects take long to write, few bytes as they are.
    write_objects(docs, path, ("arrival", "value"), _OBJECT_TASKS)
    folder = F.regexp_extract("key", "^(.*)/[^/]*[.]json$", 1).alias("folder")
    found = list_objects(spark, path).where(F.col("key").endswith(".json")).groupBy(folder).agg(F.count("*").alias("objects"))
    below = list_objects(spark, path, "arrival=src1").where(F.col("key").endswith(".json")).select(folder.alias("listed")).distinct()
    return found.join(below, F.col("folder") == F.col("listed"), "left").select("folder", F.col("listed").isNotNull().alias("has_prefix"), "objects")


@register(
    QUERIES,
    """SELECT event_id, 'null key: user_id' AS reason, NULL AS line FROM events WHERE event_type = 'signup'
    UNION ALL SELECT NULL, 'corrupt record', '{"event_id": ' || event_id FROM events WHERE event_type = 'error'
    UNION ALL SELECT event_id, 'stored', NULL FROM events WHERE event_type NOT IN ('signup', 'error')""",
)
def quarantine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncated lines and records without a key are set aside, the rest stays."""
    events = table(spark, sf_dir, "events")
    whole = F.to_json(F.struct("event_id", F.when(F.col("event_type") != "signup", F.col("user_id")).alias("user_id")))
    line = F.when(
        F.col("event_type") == "error", F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"))
    ).otherwise(whole)
    path = fresh_path(spark, "lines")
    events.select(line.alias("value")).write.text(path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType())])
    good, bad = split_valid(read_batch(spark, [path], "json", schema), ["user_id"])
    return good.select("event_id", F.lit("stored").alias("reason"), F.lit(None).cast("string").alias("line")).unionByName(
        bad.select("event_id", F.col(REASON_COLUMN).alias("reason"), F.col(CORRUPT_COLUMN).alias("line"))
    )


# ---- whole runs -----------------------------------------------------------------


@register(
    QUERIES,
    f"""SELECT {_EVENT_COLUMNS}, {_EVENT_DATES} FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts DESC) AS rn
        FROM events) r WHERE rn = 1""",
)
def ingest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON files with ``$`` in their column names, through the SQL transform, into a partitioned table."""
    raw = _dollar_events(spark, sf_dir)
    path = _write_json(raw, spark, "$event_type")
    config = IngestConfig.from_arguments(
        {
            "--JOB_NAME": "events",
            "--HUDI_RECORD_KEY": "user_id",
            "--HUDI_PRECOMB_KEY": "ts",
            "--ENABLE_PARTITION": "True",
            "--PARTITON_FIELDS": "year,month",
            "--USE_SQL_TRANSFORMER": "True",
            "--SQL_TRANSFORMER_QUERY": DATE_PARTS_QUERY,
            "--TARGET_S3_PATH": fresh_path(spark, "target"),
            "--ENABLE_HIVE_SYNC": "False",
        }
    )
    ingest_batch(spark, config, [path], schema=raw.schema)
    return VersionedTable(spark, config.target_path, config.table).snapshot()


def _order_config(spark: SparkSession, **options) -> IngestConfig:
    return IngestConfig(
        target_path=fresh_path(spark, "target"),
        record_key=("o_custkey",),
        ordering=("o_orderdate", "o_orderkey"),
        partitions=("year",),
        codec="zstd",
        **options,
    )


@register(QUERIES, f"{ORDERS_SQL} {latest('all_orders', 'o_custkey')}")
def stream_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order files, a few per micro-batch, upserted in event-time order."""
    orders = all_orders(spark, sf_dir)
    path = _write_json(orders, spark, "o_orderpriority")
    config = _order_config(spark, index_type=GLOBAL_INDEX, merge_mode=EVENT_TIME)
    drain_files(spark, config, path, orders.schema, fresh_path(spark, "progress"), max_files=2)
    return VersionedTable(spark, config.target_path, config.table).snapshot()


@register(QUERIES, f"{ORDERS_SQL} SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, "
                   "o_orderpriority, year FROM all_orders")
def stream_drain_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain inserts: a second drain from the same progress adds nothing."""
    orders = all_orders(spark, sf_dir)
    path = _write_json(orders, spark, "o_orderpriority")
    config = _order_config(spark, operation="insert")
    progress = fresh_path(spark, "progress")
    for _ in range(2):
        drain_files(spark, config, path, orders.schema, progress, max_files=3)
    return VersionedTable(spark, config.target_path, config.table).snapshot()


@register(
    QUERIES,
    f"{ORDERS_SQL} {latest('all_orders', 'o_custkey, year', 'o_orderdate DESC, o_orderkey DESC')}",
)
def notification_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of notifications naming the order files, instead of the files themselves."""
    orders = all_orders(spark, sf_dir)
    path = _write_json(orders, spark, "o_orderpriority")
    record = F.struct(
        F.lit("ObjectCreated:Put").alias("eventName"),
        F.struct(
            F.struct(F.element_at(F.split("key", "/"), 1).alias("name")).alias("bucket"),
            F.struct(F.url_encode(F.element_at(F.split("key", "/"), 2)).alias("key")).alias("object"),
        ).alias("s3"),
    )
    messages = list_objects(spark, path).where(F.col("key").endswith(".json")).select(
        F.to_json(F.struct(F.array(record).alias("Records"))).alias("value")
    )
    queue = fresh_path(spark, "queue")
    messages.write.text(queue)
    config = _order_config(spark, merge_mode=EVENT_TIME)
    stream = spark.readStream.option("maxFilesPerTrigger", "1").text(queue)
    drain_messages(
        stream,
        config,
        fresh_path(spark, "progress"),
        body="value",
        path_template=f"{path}/%s/%s",
        schema=orders.schema,
    )
    return VersionedTable(spark, config.target_path, config.table).snapshot()


@register(QUERIES, "SELECT CAST(3 AS BIGINT) AS batches, CAST(2 AS BIGINT) AS largest, count(*) AS n FROM orders")
def stream_batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five files, two per micro-batch, make three commits."""
    orders = all_orders(spark, sf_dir)
    path = _write_json(orders.repartition("o_orderpriority"), spark, "o_orderpriority")
    config = _order_config(spark, operation="insert")
    drain_files(spark, config, path, orders.schema, fresh_path(spark, "progress"), max_files=2)
    held = VersionedTable(spark, config.target_path, config.table)
    commit = F.regexp_extract("_metadata.file_path", "_commit(?:=|%3D)([0-9]+)", 1).alias("batch")
    stored = spark.read.parquet(held.data_root).select(commit, "o_orderpriority")
    batches = stored.groupBy("batch").agg(F.countDistinct("o_orderpriority").alias("files"), F.count("*").alias("n"))
    return batches.agg(F.count("*").alias("batches"), F.max("files").alias("largest"), F.sum("n").alias("n"))


@register(
    QUERIES,
    """SELECT 'null key: o_custkey' AS reason, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
    UNION ALL SELECT 'stored', count(*) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')""",
)
def quarantine_two_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams into one table; what either sets aside stays."""
    orders = all_orders(spark, sf_dir)
    bad = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    keyless = orders.withColumn("o_custkey", F.when(~bad, F.col("o_custkey")))
    config = _order_config(spark, operation="insert")
    for own in ("1-URGENT", "2-HIGH"):
        other = {"1-URGENT": ("3-MEDIUM",), "2-HIGH": ("4-NOT SPECIFIED", "5-LOW")}[own]
        path = _write_json(keyless.where(F.col("o_orderpriority").isin(own, *other)), spark, "o_orderpriority")
        drain_files(spark, config, path, orders.schema, fresh_path(spark, "progress"))
    rejected = spark.read.json(f"{config.target_path}/_quarantine/rows").groupBy(F.col(REASON_COLUMN).alias("reason")).agg(F.count("*").alias("n"))
    stored = VersionedTable(spark, config.target_path, config.table).snapshot().agg(F.count("*").alias("n"))
    return rejected.unionByName(stored.select(F.lit("stored").alias("reason"), "n"))


@register(
    QUERIES,
    """SELECT 'object not found' AS what, count(DISTINCT o_orderpriority) AS n FROM orders WHERE o_orderpriority < '3'
    UNION ALL SELECT 'stored', count(*) FROM orders WHERE o_orderpriority >= '3'""",
)
def missing_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of notifications, two of whose objects are gone by the time it is read."""
    orders = all_orders(spark, sf_dir)
    path = _write_json(orders.where("o_orderpriority >= '3'"), spark, "o_orderpriority")
    record = F.struct(F.struct(F.struct(F.lit("x").alias("name")).alias("bucket"), F.struct(F.col("key").alias("key")).alias("object")).alias("s3"))
    here = list_objects(spark, path).where(F.col("key").endswith(".json")).select(F.url_encode("key").alias("key"))
    gone = orders.where("o_orderpriority < '3'").select(F.concat(F.lit("gone/"), F.col("o_orderpriority")).alias("key")).distinct()
    queue = fresh_path(spark, "queue")
    here.union(gone).select(F.to_json(F.struct(F.array(record).alias("Records"))).alias("value")).write.text(queue)
    config = _order_config(spark, operation="insert")
    stream = spark.readStream.option("maxFilesPerTrigger", "3").text(queue)
    drain_messages(stream, config, fresh_path(spark, "progress"), body="value", path_template=f"{path}%.0s/%s", schema=orders.schema)
    rejected = spark.read.json(f"{config.target_path}/_quarantine/objects").groupBy(F.col(REASON_COLUMN).alias("what")).agg(F.count("*").alias("n"))
    stored = VersionedTable(spark, config.target_path, config.table).snapshot().agg(F.count("*").alias("n"))
    return rejected.unionByName(stored.select(F.lit("stored").alias("what"), "n"))
