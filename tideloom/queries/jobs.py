"""Job registry: one job per market segment and nation, one run request per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import activation_state, effective_config, prepare_jobs, register_jobs, reject_runs, resolve_runs
from ..plans.config import DEFAULTS
from .fixtures import table
from .registered import Query, register

QUERIES: dict[str, Query] = {}

# A job's table is named after the segment, its name after segment and nation.
# Jobs of nations below 12 are active; the shared name QUEUE_URL occurs in both
# the payload and the queue settings.
_JOBS_SQL = """
WITH jobs AS (
    SELECT 'job-' || c_mktsegment || '-' || c_nationkey AS job_name, c_mktsegment AS table_name,
           c_nationkey AS nation, CASE WHEN c_nationkey < 12 THEN 'True' ELSE 'False' END AS active,
           '2024-01-' || lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') AS created_at,
           CAST(count(*) AS BIGINT) AS customers
    FROM customer GROUP BY c_mktsegment, c_nationkey
)
"""


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("customers"))
    nation = F.col("c_nationkey").cast("string")
    return jobs.select(
        F.concat_ws("-", F.lit("job"), "c_mktsegment", nation).alias("job_name"),
        F.col("c_mktsegment").alias("table_name"),
        F.when(F.col("c_nationkey") < 12, "True").otherwise("False").alias("active"),
        F.lit(None).cast("string").alias("created_by"),
        F.lit(None).cast("string").alias("cron_schedule"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0")).alias("created_at"),
        F.create_map(
            F.lit("s3_ingestion_path"), F.concat(F.lit("s3://bkt-"), nation, F.lit("/raw/")),
            F.lit("aws_account_id"), F.lit("000000000000"),
        ).alias("s3_ingestion_config"),
        F.create_map(
            F.lit("HUDI_RECORD_KEY"), F.concat(F.lit("key_"), nation),
            F.lit("HUDI_PRECOMB_KEY"), F.col("customers").cast("string"),
            F.lit("QUEUE_URL"), F.lit("from the payload"),
        ).alias("glue_payload"),
    )


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = prepare_jobs(_definitions(spark, sf_dir), created_at=F.col("created_at"))
    queues = F.create_map(
        F.lit("QUEUE_URL"), F.concat(F.lit("queue of "), F.col("job_name")),
        F.lit("QUEUE_ARN"), F.get_json_object("sqs", "$.QUEUE_ARN"),
    )
    return rows.withColumn("sqs", F.to_json(queues))


@register(
    QUERIES,
    f"""{_JOBS_SQL}
    SELECT job_name, table_name, active, created_at, 'datateam' AS created_by, '0/15 * * * ? *' AS cron_schedule,
           'bkt-' || nation AS bucket, table_name || '-ingestion-queue' AS sqs_queue_name,
           table_name || '-event-forward-to--' || table_name || '-ingestion-queue' AS s3_event_name,
           'arn:aws:sqs:us-east-1:000000000000:' || table_name || '-ingestion-queue' AS queue_arn,
           'arn:aws:sqs:us-east-1:000000000000:' || table_name || '-ingestion-queue-dlq' AS dead_letter_arn,
           CAST(customers AS VARCHAR) AS ordering
    FROM jobs""",
    name="prepare_jobs",
)
def registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = prepare_jobs(_definitions(spark, sf_dir), created_at=F.col("created_at"))
    field = F.get_json_object
    return rows.select(
        "job_name", "table_name", "active", "created_at", "created_by", "cron_schedule",
        field("s3_ingestion_config", "$.bucket").alias("bucket"),
        field("s3_ingestion_config", "$.sqs_queue_name").alias("sqs_queue_name"),
        field("s3_ingestion_config", "$.s3_event_name").alias("s3_event_name"),
        field("sqs", "$.QUEUE_ARN").alias("queue_arn"),
        field("sqs", "$.DLQ_QUEUE_ARN").alias("dead_letter_arn"),
        field("glue_payload", "$.HUDI_PRECOMB_KEY").alias("ordering"),
    )


@register(
    QUERIES,
    f"""{_JOBS_SQL}
    SELECT job_name, table_name, CASE WHEN nation >= 12 THEN 'True' ELSE active END AS active,
           CASE WHEN nation >= 12 THEN '2024-02-01' ELSE created_at END AS created_at
    FROM jobs""",
    name="register_jobs",
)
def put_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registering inactive jobs again, as active, replaces them."""
    registry = _registry(spark, sf_dir)
    again = registry.where("active = 'False'").withColumns(
        {"active": F.lit("True"), "created_at": F.lit("2024-02-01")}
    )
    return register_jobs(registry, again).select("job_name", "table_name", "active", "created_at")


@register(
    QUERIES,
    f"""{_JOBS_SQL}
    SELECT job_name, table_name, 'Glue_Job_Fire_' || table_name AS rule_name,
           CASE WHEN active = 'True' THEN 'ENABLED' ELSE 'DISABLED' END AS state,
           'cron(0/15 * * * ? *)' AS schedule_expression,
           table_name || '-ingestion-queue' AS queue_name, table_name || '-ingestion-queue-dlq' AS dead_letter_name,
           table_name || '-event-forward-to--' || table_name || '-ingestion-queue' AS event_name
    FROM jobs""",
    name="activation_state",
)
def job_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activation_state(_registry(spark, sf_dir))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of nation 0 ask for a job that does not exist."""
    nation = F.col("c_nationkey").cast("string")
    job = F.when(F.col("c_nationkey") == 0, "no such job").otherwise(F.concat_ws("-", F.lit("job"), "c_mktsegment", nation))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("table_name"), job.alias("job_name")
    )


_ARGUMENTS_SQL = """
    SELECT c.c_custkey, a.name, CASE a.name
        WHEN '--HUDI_RECORD_KEY' THEN 'key_' || j.nation
        WHEN '--HUDI_PRECOMB_KEY' THEN CAST(j.customers AS VARCHAR)
        WHEN '--QUEUE_URL' THEN 'queue of ' || j.job_name
        ELSE 'arn:aws:sqs:us-east-1:000000000000:' || j.table_name || '-ingestion-queue' END AS value
    FROM asking c JOIN jobs j ON {match}
    CROSS JOIN (VALUES ('--HUDI_RECORD_KEY'), ('--HUDI_PRECOMB_KEY'), ('--QUEUE_URL'), ('--QUEUE_ARN')) a(name)
"""


@register(
    QUERIES,
    _JOBS_SQL
    + ", asking AS (SELECT * FROM customer WHERE c_nationkey <> 0)"
    + _ARGUMENTS_SQL.format(match="j.table_name = c.c_mktsegment AND j.nation = c.c_nationkey"),
    name="resolve_runs",
)
def runs_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = resolve_runs(_requests(spark, sf_dir), _registry(spark, sf_dir))
    return runs.select("c_custkey", F.explode("arguments").alias("name", "value"))


@register(
    QUERIES,
    _JOBS_SQL
    + ", asking AS (SELECT * FROM customer)"
    + _ARGUMENTS_SQL.format(
        match="j.table_name = c.c_mktsegment AND j.nation = "
        "(SELECT max(nation) FROM jobs k WHERE k.table_name = c.c_mktsegment)"
    ),
)
def resolve_runs_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched on the table alone: the job registered last is run."""
    runs = resolve_runs(_requests(spark, sf_dir), _registry(spark, sf_dir), match=("table_name",))
    return runs.select("c_custkey", F.explode("arguments").alias("name", "value"))


def _default_sql(name: str) -> str:
    default = DEFAULTS[name]
    return "CAST(NULL AS VARCHAR)" if default is None else f"'{default}'"


@register(
    QUERIES,
    _JOBS_SQL
    + "SELECT c.c_custkey AS request_c_custkey, c.c_mktsegment AS request_table_name, j.job_name AS request_job_name, "
    + "'key_' || j.nation AS hudi_record_key, CAST(j.customers AS VARCHAR) AS hudi_precomb_key, "
    + "'queue of ' || j.job_name AS queue_url, "
    + ", ".join(
        f"{_default_sql(name)} AS {name.lower()}"
        for name in DEFAULTS
        if name not in ("HUDI_RECORD_KEY", "HUDI_PRECOMB_KEY", "QUEUE_URL")
    )
    + " FROM customer c JOIN jobs j ON j.table_name = c.c_mktsegment AND j.nation = c.c_nationkey"
    + " WHERE c.c_nationkey <> 0",
    name="effective_config",
)
def run_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effective_config(resolve_runs(_requests(spark, sf_dir), _registry(spark, sf_dir)))


@register(
    QUERIES,
    _JOBS_SQL
    + """SELECT c.c_custkey, '--' || a.name AS name, CASE a.name
        WHEN 'QUEUE_URL' THEN 'https://queues/' || j.job_name WHEN 'DLQ_QUEUE_URL' THEN 'https://dead/' || j.job_name
        WHEN 'HUDI_RECORD_KEY' THEN 'key_' || j.nation WHEN 'HUDI_PRECOMB_KEY' THEN CAST(j.customers AS VARCHAR)
        WHEN 'QUEUE_ARN' THEN 'arn:aws:sqs:us-east-1:000000000000:' || j.table_name || '-ingestion-queue'
        ELSE 'arn:aws:sqs:us-east-1:000000000000:' || j.table_name || '-ingestion-queue-dlq' END AS value
    FROM customer c JOIN jobs j ON j.table_name = c.c_mktsegment AND j.nation = c.c_nationkey
    CROSS JOIN (VALUES ('QUEUE_URL'), ('DLQ_QUEUE_URL'), ('HUDI_RECORD_KEY'), ('HUDI_PRECOMB_KEY'), ('QUEUE_ARN'), ('DLQ_QUEUE_ARN')) a(name)
    WHERE c.c_nationkey <> 0""",
)
def resolve_registered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue addresses of the definitions reach the runs through the registry as it is written."""
    addressed = _definitions(spark, sf_dir).withColumns(
        {"queue_url": F.concat(F.lit("https://queues/"), "job_name"), "dead_letter_url": F.concat(F.lit("https://dead/"), "job_name")}
    )
    registry, _ = prepare_jobs(addressed, created_at=F.col("created_at"))
    runs = resolve_runs(_requests(spark, sf_dir), registry)
    return runs.select("c_custkey", F.explode("arguments").alias("name", "value"))


@register(
    QUERIES,
    """SELECT c_custkey, CASE WHEN c_nationkey % 3 = 1 THEN 'unreadable payload' ELSE 'unreadable queue settings' END AS reason
    FROM customer WHERE c_nationkey <> 0 AND c_nationkey % 3 <> 0
    UNION ALL SELECT c_custkey, 'runs' FROM customer WHERE c_nationkey <> 0 AND c_nationkey % 3 = 0""",
    name="reject_runs",
)
def broken_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose payload or queue settings are broken JSON do not run."""
    nation = F.element_at(F.split("job_name", "-"), -1).cast("int")
    registry = _registry(spark, sf_dir).withColumns(
        {
            "glue_payload": F.when(nation % 3 == 1, "{broken").otherwise(F.col("glue_payload")),
            "sqs": F.when(nation % 3 == 2, "[1, 2]").otherwise(F.col("sqs")),
        }
    )
    requests = _requests(spark, sf_dir)
    rejected = reject_runs(requests, registry).select("c_custkey", "reason")
    return rejected.unionByName(resolve_runs(requests, registry).select("c_custkey", F.lit("runs").alias("reason")))
