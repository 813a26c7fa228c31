"""Draining a source until it is empty, with Structured Streaming.

A micro-batch counts as processed only once its table commit is published. One
that is replayed after a failure is recognised by its number in the manifest,
so operations without a key lookup are not applied twice either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.config import IngestConfig
from ..plans.pipeline import IngestResult, ingest_frame, ingest_messages, set_aside
from ..sources.files import read_stream
from .receipts import DEAD_LETTER, DELIVER, MAX_RECEIVES, RETENTION, count_receives, once


def _drain(stream: DataFrame, checkpoint: str, handle, every: str | None, until_empty: bool = False) -> list[IngestResult]:
    """With ``until_empty`` batches follow each other until the source has no more, for sources that know no fixed end."""
    done: list[IngestResult] = []

    def step(batch: DataFrame, number: int) -> None:
        # The query's id is kept in the checkpoint: a checkpoint that is begun anew is another stream.
        stream_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        done.append(handle(batch, stream_id or checkpoint, number))

    writer = stream.writeStream.foreachBatch(step)
    writer = writer.option("checkpointLocation", checkpoint)
    if until_empty and not every:
        query = writer.trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return done
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    writer.start().awaitTermination()
    return done


def drain_files(
    spark: SparkSession,
    config: IngestConfig,
    path: str,
    schema: T.StructType,
    checkpoint: str,
    fmt: str = "json",
    max_files: int | None = None,
    every: str | None = None,
) -> list[IngestResult]:
    """Ingest all files below a path that this checkpoint has not seen.

    With ``every`` (an interval) the stream keeps running instead of stopping
    once the source is empty.
    """
    stream = read_stream(spark, path, schema, fmt, max_files)
    return _drain(
        stream,
        checkpoint,
        lambda batch, stream_id, number: ingest_frame(batch, config, stream_id=stream_id, batch_id=number),
        every,
    )


def drain_messages(
    messages: DataFrame,
    config: IngestConfig,
    checkpoint: str,
    every: str | None = None,
    message_id: str | None = None,
    sent_at: str = "sent_at",
    within: str = RETENTION,
    until_empty: bool = False,
    **options,
) -> list[IngestResult]:
    """Ingest the objects named by a stream of notifications (any source with a body column).

    Given the column of a ``message_id``, a message that is delivered again within ``within``
    of its first delivery is applied once; one without an id is known by its body.
    """
    if message_id:
        messages = once(messages, message_id, sent_at, within, options.get("body", "body"))
    return _drain(
        messages,
        checkpoint,
        lambda batch, stream_id, number: ingest_messages(batch, config, stream_id=stream_id, batch_id=number, **options),
        every,
        until_empty,
    )


def drain_receipts(
    receipts: DataFrame,
    config: IngestConfig,
    checkpoint: str,
    every: str | None = None,
    message_id: str = "message_id",
    received_at: str = "received_at",
    limit: int = MAX_RECEIVES,
    keep: str = RETENTION,
    late: str = "0 seconds",
    **options,
) -> list[IngestResult]:
    """Ingest the objects named by what was received, each message up to ``limit`` times.

    A message received once more has failed so often: it goes to the quarantine, under
    ``dead_letters``, once; what comes of it after that is left alone.
    """
    counted = count_receives(receipts, message_id, received_at, limit, keep, late, options.get("body", "body"))

    def handle(batch: DataFrame, stream_id: str, number: int) -> IngestResult:
        # Counted once: both parts are read from what the state gave out.
        batch.persist()
        try:
            dead = batch.where(F.col("action") == DEAD_LETTER)
            if not dead.isEmpty():
                set_aside(dead.drop("action"), config, (stream_id, number), "dead_letters")
            due = batch.where(F.col("action") == DELIVER).drop("receives", "action")
            return ingest_messages(due, config, stream_id=stream_id, batch_id=number, **options)
        finally:
            batch.unpersist()

    return _drain(counted, checkpoint, handle, every)
