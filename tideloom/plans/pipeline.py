"""One batch from raw rows to a committed table version."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import conform_to, merged_schema, sanitize_columns
from ..operators.notifications import PATH_TEMPLATE, expand_messages, filter_events
from ..operators.transform import CORRUPT_COLUMN, REASON_COLUMN, mark_invalid, sql_transform
from ..sinks.catalog import register_table
from ..sinks.storage import Storage
from ..sinks.table import MERGE_ON_READ, VersionedTable
from ..sources.files import read_batch
from ..workspace import fresh_path
from .config import IngestConfig

LINE_COLUMN = "_line"
GONE = "object not found"


@dataclass(frozen=True)
class IngestResult:
    seq: int | None
    rows: int = 0
    rejected: int = 0
    missing_objects: tuple[str, ...] = ()


def ingest_frame(
    batch: DataFrame,
    config: IngestConfig,
    function: Callable[[DataFrame], DataFrame] | None = None,
    stream_id: str | None = None,
    batch_id: int | None = None,
) -> IngestResult:
    """Clean names, transform, set unusable rows aside, apply the operation.

    The source is evaluated once: the transformed batch is written to shared
    working storage, and everything after reads it from there.
    """
    spark = batch.sparkSession
    storage = Storage(spark)
    table = VersionedTable(spark, config.target_path, config.table)
    version = table.version(stream_id=stream_id, batch_id=batch_id)
    if version.has_batch:
        return IngestResult(None)
    required = (*config.record_key, *config.ordering, *config.partitions)
    if not batch.columns:
        return IngestResult(None)
    clean = sanitize_columns(batch)

    working: list[str] = []

    def staged(df: DataFrame, *metrics) -> tuple[DataFrame, dict]:
        path = fresh_path(spark, "batch")
        seen = Observation()
        working.append(path)
        df.observe(seen, *metrics).write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), seen.get

    try:
        rejected = 0
        if (config.sql_query is not None or function is not None) and CORRUPT_COLUMN in clean.columns:
            # Unreadable lines carry no fields a transform could work on; they leave before it.
            clean, seen = staged(clean, F.count(CORRUPT_COLUMN).alias("corrupt"))
            rejected = seen["corrupt"]
            if rejected:
                lines = clean.where(F.col(CORRUPT_COLUMN).isNotNull())
                set_aside(lines.withColumn(REASON_COLUMN, F.lit("corrupt record")), config, (stream_id, batch_id), "lines")
            clean = clean.where(F.col(CORRUPT_COLUMN).isNull()).drop(CORRUPT_COLUMN)
        shaped = sql_transform(clean, config.sql_query, function, required)
        marked = mark_invalid(shaped, config.record_key, config.partitions, config.timestamps)
        marked = conform_to(marked, merged_schema(T.StructType([]), marked.schema))
        ready, seen = staged(marked, F.count(F.lit(1)).alias("rows"), F.count(REASON_COLUMN).alias("bad"))
        if seen["bad"]:
            rejected += seen["bad"]
            set_aside(ready.where(F.col(REASON_COLUMN).isNotNull()), config, (stream_id, batch_id), "rows")
        rows = seen["rows"] - seen["bad"]
        seq = None
        if rows and config.sink:
            kept = ready.where(F.col(REASON_COLUMN).isNull()).drop(REASON_COLUMN, CORRUPT_COLUMN)
            kept.write.format(config.sink).options(**config.sink_options).mode("append").save(config.target_path)
        elif rows:
            kept = ready.where(F.col(REASON_COLUMN).isNull()).drop(REASON_COLUMN, CORRUPT_COLUMN)
            seq = table.write(kept, config.operation, stream_id=stream_id, batch_id=batch_id, version=version)
    finally:
        storage.remove_all(working)
    if seq is not None:
        if config.table_type == MERGE_ON_READ:
            table.compact_log(at_least=config.log_commits)
        if config.enable_cleaner:
            table.expire(**config.retention)
            table.remove_orphans()
        table.fold_manifests()
        if config.enable_catalog and config.database:
            register_table(table, config.database, config.table_name)
    return IngestResult(seq, rows, rejected)


def set_aside(bad: DataFrame, config: IngestConfig, batch: tuple[str | None, int | None], label: str) -> None:
    """Write rejected rows as JSON; a replayed micro-batch replaces its own earlier output and no other.

    The folder is named by the stream and its batch, or by the run outside of streams. The
    unreadable line goes under a name that the JSON reader does not use itself.
    """
    bad = bad.withColumnRenamed(CORRUPT_COLUMN, LINE_COLUMN)
    root = config.quarantine_path or f"{config.target_path.rstrip('/')}/_quarantine"
    stream_id, batch_id = batch
    stream = "none" if stream_id is None else f"s{hashlib.sha256(stream_id.encode()).hexdigest()[:16]}"
    number = f"run-{uuid.uuid4().hex[:12]}" if batch_id is None else f"n{batch_id}"
    bad.write.mode("overwrite").json(f"{root}/{label}/stream={stream}/batch={number}")


def ingest_batch(
    spark: SparkSession,
    config: IngestConfig,
    paths: Sequence[str],
    fmt: str = "json",
    schema: T.StructType | None = None,
    **options,
) -> IngestResult:
    """Ingest the objects at the given paths; those that are gone go to the quarantine and the result, and are not fatal."""
    gone = set(Storage(spark).missing(dict.fromkeys(paths)))
    there = [path for path in dict.fromkeys(paths) if path not in gone]
    if gone:
        rows = spark.createDataFrame([(path, GONE) for path in sorted(gone)], f"path string, {REASON_COLUMN} string")
        set_aside(rows, config, (options.get("stream_id"), options.get("batch_id")), "objects")
    if not there:
        return IngestResult(None, missing_objects=tuple(sorted(gone)))
    done = ingest_frame(read_batch(spark, there, fmt, schema), config, **options)
    return IngestResult(done.seq, done.rows, done.rejected, tuple(sorted(gone)))


def ingest_messages(
    messages: DataFrame,
    config: IngestConfig,
    body: str = "body",
    prefix: str | None = None,
    path_template: str = PATH_TEMPLATE,
    fmt: str = "json",
    schema: T.StructType | None = None,
    decode_keys: bool = True,
    **options,
) -> IngestResult:
    """Ingest the objects that a batch of notifications names.

    The object paths of one batch reach the driver, as Spark's file listing
    requires; the number of messages per batch bounds them.
    """
    spark = messages.sparkSession
    path = fresh_path(spark, "messages")
    try:
        # Staged once: a queue that is read again may give other messages.
        messages.write.parquet(path)
        staged = spark.read.schema(messages.schema).parquet(path)
        objects, rejected = expand_messages(staged, body, path_template, decode_keys)
        if not rejected.isEmpty():
            set_aside(rejected, config, (options.get("stream_id"), options.get("batch_id")), "messages")
        paths = [r[0] for r in filter_events(objects, prefix).select("path").distinct().collect()]
    finally:
        Storage(spark).remove(path)
    return ingest_batch(spark, config, sorted(paths), fmt, schema, **options)
