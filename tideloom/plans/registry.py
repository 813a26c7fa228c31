"""Job definitions and run requests as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import (
    activation,
    bucket_of,
    dead_letter_name,
    event_name,
    is_on,
    iso_now,
    merge_maps,
    option_or,
    prefix_keys,
    present_options,
    queue_name,
    rule_name,
    schedule_expression,
)
from ..functions.maps import ARGUMENT_PREFIX
from ..operators.keyspec import KeySpec
from ..operators.merge import merge_upsert
from .config import DEFAULTS

# The registry's columns, its key and the defaults of a job.
JOB_KEY = ("job_name", "table_name")
JOB_SCHEMA = (
    "job_name string, table_name string, active string, created_at string, created_by string, "
    "cron_schedule string, s3_ingestion_config string, sqs string, glue_payload string"
)
DEFAULT_CREATOR = "datateam"
DEFAULT_SCHEDULE = "0/15 * * * ? *"
DEFAULT_REGION = "us-east-1"
QUEUE_ARN_TEMPLATE = "arn:aws:sqs:%s:%s:%s"
MAP = "map<string,string>"


def prepare_jobs(
    definitions: DataFrame, region: str = DEFAULT_REGION, created_at: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Registry rows from job definitions, and the definitions that cannot be registered.

    A definition has ``job_name, table_name, active, created_by, cron_schedule``
    and the maps ``s3_ingestion_config`` and ``glue_payload``. The resource names
    that follow from the table name are added to the ingestion config, the
    queue names to ``sqs``; so are the addresses of queues that exist, where the
    definition has them as ``queue_url`` and ``dead_letter_url``.
    """
    config = F.col("s3_ingestion_config")
    source = F.try_element_at(config, F.lit("s3_ingestion_path"))
    account = F.try_element_at(config, F.lit("aws_account_id"))
    table = F.coalesce(F.try_element_at(config, F.lit("table_name")), F.col("table_name"))
    queue = queue_name(table)
    reason = (
        F.when(config.isNull() | (F.size(config) == 0), "no ingestion config")
        .when(bucket_of(source).isNull(), "no bucket in the ingestion path")
        .when(F.col("job_name").isNull() | F.col("table_name").isNull(), "null key")
    )
    judged = definitions.withColumn("reason", reason)

    derived = F.create_map(
        F.lit("sqs_queue_name"), queue,
        F.lit("bucket"), bucket_of(source),
        F.lit("s3_event_name"), event_name(table),
    )
    arn = lambda name: F.format_string(QUEUE_ARN_TEMPLATE, F.lit(region), account, name)
    queues = F.create_map(
        F.lit("QUEUE_ARN"), arn(queue),
        F.lit("DLQ_QUEUE_ARN"), arn(dead_letter_name(queue)),
    )
    given = {"QUEUE_URL": "queue_url", "DLQ_QUEUE_URL": "dead_letter_url"}
    known = [x for name, column in given.items() if column in definitions.columns for x in (F.lit(name), F.col(column))]
    addresses = F.map_filter(F.create_map(*known).cast(MAP), lambda _, address: address.isNotNull())
    rows = judged.where(F.col("reason").isNull()).select(
        "job_name",
        "table_name",
        F.coalesce(F.col("active"), F.lit("False")).alias("active"),
        (iso_now() if created_at is None else created_at).alias("created_at"),
        F.coalesce(F.col("created_by"), F.lit(DEFAULT_CREATOR)).alias("created_by"),
        F.coalesce(F.col("cron_schedule"), F.lit(DEFAULT_SCHEDULE)).alias("cron_schedule"),
        F.to_json(merge_maps(config, derived)).alias("s3_ingestion_config"),
        F.to_json(merge_maps(queues, addresses)).alias("sqs"),
        F.to_json(F.coalesce(F.col("glue_payload"), F.create_map().cast(MAP))).alias("glue_payload"),
    )
    return rows, judged.where(F.col("reason").isNotNull())


def register_jobs(registry: DataFrame, jobs: DataFrame) -> DataFrame:
    """Put by composite key: a job that is registered already is replaced."""
    spec = KeySpec(keys=JOB_KEY, ordering=("created_at",), global_keys=True)
    return merge_upsert(registry, jobs, spec)


def activation_state(registry: DataFrame) -> DataFrame:
    """The schedule rule that belongs to each job."""
    return registry.select(
        *JOB_KEY,
        rule_name(F.col("table_name")).alias("rule_name"),
        activation(is_on("active")).alias("state"),
        schedule_expression(F.col("cron_schedule")).alias("schedule_expression"),
        queue_name(F.col("table_name")).alias("queue_name"),
        dead_letter_name(queue_name(F.col("table_name"))).alias("dead_letter_name"),
        event_name(F.col("table_name")).alias("event_name"),
    )


def _matched(requests: DataFrame, registry: DataFrame, match: Sequence[str]) -> DataFrame:
    """Requests with the merged settings of their job, and what is wrong with those."""
    if "table_name" not in match:
        raise ValueError("requests are matched on the table name at least")
    jobs = registry.select(*JOB_KEY, "created_at", "glue_payload", "sqs")
    if set(match) != set(JOB_KEY):
        newest = Window.partitionBy(*match).orderBy(F.col("created_at").desc_nulls_last(), F.col("job_name").desc())
        jobs = jobs.withColumn("__rank", F.row_number().over(newest)).where(F.col("__rank") == 1)
    broken = lambda name: F.col(name).isNotNull() & ~F.coalesce(F.schema_of_variant(F.try_parse_json(name)).startswith("OBJECT"), F.lit(False))
    jobs = jobs.select(
        *[F.col(name).alias(f"__job_{name}") for name in match],
        F.when(broken("glue_payload"), "unreadable payload").when(broken("sqs"), "unreadable queue settings").alias("__reason"),
        merge_maps(F.from_json("glue_payload", MAP), F.from_json("sqs", MAP)).alias("__merged"),
    )
    return requests.join(jobs, [F.col(name) == F.col(f"__job_{name}") for name in match], "inner")


def resolve_runs(requests: DataFrame, registry: DataFrame, match: Sequence[str] = JOB_KEY) -> DataFrame:
    """Run arguments for each request whose job is registered.

    Payload and queue settings are merged, queue settings winning, and every
    name gets the argument prefix. Matching on the table name alone takes the
    job of that table registered last. A job whose settings cannot be read does
    not run; see ``reject_runs``.
    """
    runs = _matched(requests, registry, match).where(F.col("__reason").isNull())
    return runs.select(*[F.col(name) for name in requests.columns], prefix_keys(F.col("__merged")).alias("arguments"))


def reject_runs(requests: DataFrame, registry: DataFrame, match: Sequence[str] = JOB_KEY) -> DataFrame:
    """Requests whose job is registered with settings that are no JSON object, with the reason."""
    runs = _matched(requests, registry, match).where(F.col("__reason").isNotNull())
    return runs.select(*[F.col(name) for name in requests.columns], F.col("__reason").alias("reason"))


def effective_config(runs: DataFrame) -> DataFrame:
    """The known arguments of each run as columns, defaults filled in; others are dropped."""
    known = present_options(F.col("arguments"), [ARGUMENT_PREFIX + name for name in DEFAULTS])
    kept = runs.withColumn("arguments", known)
    settings = [
        option_or(F.col("arguments"), ARGUMENT_PREFIX + name, default).alias(name.lower())
        for name, default in DEFAULTS.items()
    ]
    return kept.select(
        *[F.col(name).alias(f"request_{name}") for name in runs.columns if name != "arguments"], *settings
    )
