"""Text expressions: object addresses, resource names and the run clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name templates of the resources that belong to a table.
QUEUE_TEMPLATE = "%s-ingestion-queue"
DEAD_LETTER_TEMPLATE = "%s-dlq"
EVENT_TEMPLATE = "%s-event-forward-to--%s"
RULE_TEMPLATE = "Glue_Job_Fire_%s"
SCHEDULE_TEMPLATE = "cron(%s)"
BUCKET_PATTERN = r"^s3://([^/]+)/"


def bucket_of(uri: Column, pattern: str = BUCKET_PATTERN) -> Column:
    """The bucket of an object address, null where the address does not have the form."""
    found = F.regexp_extract(uri, pattern, 1)
    return F.when(found != "", found)


def decode_object_key(key: Column) -> Column:
    """Undo the URL encoding of a key in a notification; a key that is not encoded stays as it is."""
    return F.coalesce(F.try_url_decode(key), key)


def queue_name(table: Column) -> Column:
    return F.format_string(QUEUE_TEMPLATE, table)


def dead_letter_name(queue: Column) -> Column:
    return F.format_string(DEAD_LETTER_TEMPLATE, queue)


def event_name(table: Column) -> Column:
    return F.format_string(EVENT_TEMPLATE, table, queue_name(table))


def rule_name(table: Column) -> Column:
    return F.format_string(RULE_TEMPLATE, table)


def schedule_expression(cron: Column) -> Column:
    return F.format_string(SCHEDULE_TEMPLATE, cron)


def activation(is_active: Column) -> Column:
    return F.when(is_active, F.lit("ENABLED")).otherwise(F.lit("DISABLED"))


def iso_now(at: dt.datetime | None = None) -> Column:
    """The given time, or the time of the query, as ISO text."""
    if at is not None:
        return F.lit(at.isoformat())
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
