import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.plans import IngestConfig, ingest_batch, ingest_frame, ingest_messages
from tideloom.plans import activation_state, effective_config, prepare_jobs, register_jobs, resolve_runs
from tideloom.plans.config import DEFAULTS
from tideloom.plans.registry import JOB_SCHEMA
from tideloom.queries.ingest import QUERIES
from tideloom.sinks import VersionedTable, write_objects
from tideloom.sources import list_objects, read_batch
from tideloom.streaming import drain_files, drain_messages

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("customer_id", "name", "ts")])
DATES = "SELECT *, year(try_to_timestamp(ts)) AS year, month(try_to_timestamp(ts)) AS month FROM temp;"


def put(root, name, records, tail=""):
    os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
    with open(f"{root}/{name}", "w") as f:
        f.write("".join(json.dumps(r) + "\n" for r in records) + tail)
    return f"{root}/{name}"


def config(path, **options):
    return IngestConfig(
        **{
            "target_path": path + "/target",
            "record_key": ("customer_id",),
            "ordering": ("ts",),
            "partitions": ("year", "month"),
            "sql_query": DATES,
            **options,
        }
    )


def target(spark, c):
    return VersionedTable(spark, c.target_path, c.table)


def test_arguments_become_a_config():
    arguments = {
        "--JOB_NAME": "j",
        "--HUDI_RECORD_KEY": "a, b",
        "--HUDI_PRECOMB_KEY": "ts",
        "--TARGET_S3_PATH": "/t",
        "--ENABLE_PARTITION": "true",
        "--PARTITON_FIELDS": "year,month",
        "--INDEX_TYPE": "GLOBAL_BLOOM",
        "--unknown": "x",
    }
    c = IngestConfig.from_arguments(arguments)
    assert (c.record_key, c.partitions, c.operation, c.table_type) == (("a", "b"), ("year", "month"), "upsert", "COPY_ON_WRITE")
    assert c.key.global_keys and not c.key.event_time and c.sql_query is None and not c.enable_cleaner
    named = {"job_name": "j", "record_key": "k", "target_path": "/t", "enable_partition": True, "partition_fields": "p"}
    assert IngestConfig.from_arguments(named).partitions == ("p",)
    off = IngestConfig.from_arguments({"JOB_NAME": "j", "HUDI_RECORD_KEY": "k", "TARGET_S3_PATH": "/t"})
    assert off.partitions == () and off.retention == {"versions": 3}


@pytest.mark.parametrize(
    "broken",
    [
        {"JOB_NAME": ""},
        {"HUDI_RECORD_KEY": ""},
        {"TARGET_S3_PATH": ""},
        {"HUDI_METHOD": "merge"},
        {"INDEX_TYPE": "SIMPLE"},
        {"ENABLE_PARTITION": "True"},
        {"USE_SQL_TRANSFORMER": "True"},
    ],
)
def test_unusable_arguments_are_refused(broken):
    with pytest.raises(ValueError):
        IngestConfig.from_arguments({"JOB_NAME": "j", "HUDI_RECORD_KEY": "k", "TARGET_S3_PATH": "/t", **broken})


def test_a_batch_from_files_to_table(spark, path):
    a = put(path, "raw/a.json", [{"customer_id$": "1", "name": "x", "ts": "2024-01-05T00:00:00"}])
    b = put(path, "raw/deep/b.json", [{"customer_id$": "1", "name": "y", "ts": "2024-01-06T00:00:00.5"},
                                      {"customer_id$": None, "name": "lost", "ts": "2024-01-06T00:00:00"}])
    c = config(path, enable_catalog=True, enable_cleaner=True, database="ingest_db", table_name="customers")
    done = ingest_batch(spark, c, [a, b, b, f"{path}/raw/gone.json"])
    assert (done.seq, done.rows, done.rejected, done.missing_objects) == (1, 2, 1, (f"{path}/raw/gone.json",))
    assert [(r.customer_id, r.name, r.year) for r in target(spark, c).snapshot().collect()] == [("1", "y", 2024)]
    assert spark.table("ingest_db.customers").first().name == "y"
    assert spark.read.json(c.target_path + "/_quarantine/rows").first()._reason == "null key: customer_id"
    later = put(path, "raw/c.json", [{"customer_id$": "1", "name": "z", "ts": "2024-01-01T00:00:00", "new_col": "n"}])
    ingest_batch(spark, c, [later])
    assert [(r.name, r.new_col) for r in spark.table("ingest_db.customers").collect()] == [("z", "n")]


def test_corrupt_lines_and_bad_times_are_set_aside(spark, path):
    f = put(path, "raw/a.json", [{"customer_id": "1", "name": "x", "ts": "2024-01-05T00:00:00"},
                                 {"customer_id": "2", "name": "x", "ts": "junk"}], tail='{"customer_id": \n')
    c = config(path, timestamps=("ts",))
    done = ingest_batch(spark, c, [f], schema=SCHEMA)
    assert (done.rows, done.rejected) == (1, 2)
    lines = spark.read.json(c.target_path + "/_quarantine/lines").first()
    assert lines._line.startswith('{"customer_id"')
    plain = config(path + "/p", sql_query=None, partitions=())
    done = ingest_batch(spark, plain, [f], schema=SCHEMA)
    assert (done.rows, done.rejected) == (2, 1)
    assert "_corrupt_record" not in target(spark, plain).snapshot().columns


def test_nothing_to_do(spark, path):
    c = config(path)
    assert ingest_batch(spark, c, []).seq is None
    assert ingest_frame(spark.createDataFrame([], SCHEMA), c).seq is None
    f = put(path, "raw/a.json", [{"customer_id": "1", "name": "x", "ts": "2024-01-05T00:00:00"}])
    filtering = config(path, sql_query=DATES.rstrip(";") + " WHERE name = 'none'")
    assert ingest_batch(spark, filtering, [f]).seq is None
    assert not target(spark, c).exists()


def test_operations_by_name(spark, path):
    rows = [{"customer_id": str(i), "name": "x", "ts": f"2024-0{1 + i % 2}-05T00:00:00"} for i in range(4)]
    f = put(path, "raw/a.json", rows)
    for operation, left in (("upsert", 4), ("insert", 8), ("delete", 0), ("bulk_insert", 4), ("delete_partition", 0)):
        c = config(path, operation=operation)
        ingest_batch(spark, c, [f])
        assert target(spark, c).snapshot().count() == left, operation


def test_another_sink_gets_the_cleaned_rows(spark, path):
    rows = [{"customer_id$": "1", "name": "x", "ts": "2024-01-05T00:00:00"}, {"name": "y", "ts": "2024-01-05T00:00:00"}]
    f = put(path, "raw/a.json", rows)
    c = config(path, sink="parquet", sink_options={"compression": "snappy"})
    for _ in range(2):
        assert ingest_batch(spark, c, [f]).rejected == 1
    assert [(r.customer_id, r.year) for r in spark.read.parquet(c.target_path).collect()] == [("1", 2024)] * 2


def test_formats(spark, path):
    with pytest.raises(ValueError):
        read_batch(spark, ["x"], "csv")
    assert read_batch(spark, [], schema=SCHEMA).isEmpty()
    assert list_objects(spark, path + "/absent").isEmpty()
    spark.createDataFrame([(1,)], "a int").write.parquet(path + "/pq/x=1")
    spark.createDataFrame([(2, 3)], "a int, b int").write.parquet(path + "/pq/x=2")
    assert {tuple(r) for r in read_batch(spark, [path + "/pq"], "parquet").collect()} == {(1, None), (2, 3)}


def test_stream_equals_batch(spark, path):
    names = [
        put(path, f"raw/{i % 2}/f{i}.json",
            [{"customer_id": str(j % 7), "name": f"{i}.{j}", "ts": f"2024-0{1 + i % 3}-{10 + j}T00:00:{i:02d}"} for j in range(9)])
        for i in range(6)
    ]
    options = {"merge_mode": "event_time", "index_type": "GLOBAL_BLOOM"}
    streamed, batched = config(path + "/s", **options), config(path + "/b", **options)
    done = drain_files(spark, streamed, path + "/raw", SCHEMA, path + "/progress", max_files=4)
    assert len(done) == 2
    ingest_batch(spark, batched, names, schema=SCHEMA)
    rows = lambda c: sorted(tuple(r) for r in target(spark, c).snapshot().collect())
    assert rows(streamed) == rows(batched)
    assert drain_files(spark, streamed, path + "/raw", SCHEMA, path + "/progress", max_files=4) == []
    put(path, "raw/late.json", [{"customer_id": "new", "name": "n", "ts": "2024-05-01T00:00:00"}])
    drain_files(spark, streamed, path + "/raw", SCHEMA, path + "/progress")
    assert len(rows(streamed)) == 8


def test_replayed_micro_batch_is_skipped(spark, path):
    df = spark.createDataFrame([("1", "x", "2024-01-01"), (None, "y", "2024-01-01")], SCHEMA)
    c = config(path, operation="insert")
    assert ingest_frame(df, c, stream_id="s", batch_id=4).seq == 1
    assert ingest_frame(df, c, stream_id="s", batch_id=4).seq is None
    assert target(spark, c).snapshot().count() == 1
    assert spark.read.json(c.target_path + "/_quarantine/rows").count() == 1


def message(bucket, *keys, event="ObjectCreated:Put"):
    return json.dumps(
        {"Records": [{"eventName": event, "s3": {"bucket": {"name": bucket}, "object": {"key": k}}} for k in keys]}
    )


def test_messages_to_table(spark, path):
    put(path, "bkt/raw/a b.json", [{"customer_id": "1", "name": "x", "ts": "2024-01-05T00:00:00"}])
    put(path, "bkt/other/c.json", [{"customer_id": "2", "name": "x", "ts": "2024-01-05T00:00:00"}])
    bodies = [(message("bkt", "raw/a+b.json", "raw/gone.json", "other/c.json"),), ("junk",), (message("bkt", "raw/a+b.json"),)]
    c = config(path)
    done = ingest_messages(
        spark.createDataFrame(bodies, "body string"), c, prefix="raw/", path_template=f"{path}/%s/%s", schema=SCHEMA
    )
    assert done.rows == 1 and done.missing_objects == (f"{path}/bkt/raw/gone.json",)
    assert [r.customer_id for r in target(spark, c).snapshot().collect()] == ["1"]
    assert spark.read.json(c.target_path + "/_quarantine/messages").first().reason == "not json"


def test_message_stream(spark, path):
    for i in range(3):
        put(path, f"bkt/raw/{i}.json", [{"customer_id": str(i), "name": "x", "ts": "2024-01-05T00:00:00"}])
        os.makedirs(path + "/queue", exist_ok=True)
        with open(f"{path}/queue/{i}.txt", "w") as f:
            f.write(message("bkt", f"raw/{i}.json") + "\n")
    c = config(path)
    stream = spark.readStream.option("maxFilesPerTrigger", "2").text(path + "/queue")
    drain_messages(stream, c, path + "/progress", body="value", path_template=f"{path}/%s/%s", schema=SCHEMA)
    assert target(spark, c).snapshot().count() == 3


def definitions(spark):
    maps = "map<string,string>"
    rows = [
        ("j1", "t1", "True", None, None, {"s3_ingestion_path": "s3://b/x", "aws_account_id": "1", "table_name": "t1"}, {"a": "1"}),
        ("j2", "t1", None, "me", "0 1 * * ? *", {"s3_ingestion_path": "s3://b/x", "aws_account_id": "1"}, None),
        ("j3", "t3", "True", None, None, {"s3_ingestion_path": "nowhere"}, None),
        ("j4", "t4", "True", None, None, {}, None),
    ]
    columns = f"job_name string, table_name string, active string, created_by string, cron_schedule string, s3_ingestion_config {maps}, glue_payload {maps}"
    return spark.createDataFrame(rows, columns)


def test_job_definitions(spark):
    rows, refused = prepare_jobs(definitions(spark), created_at=F.lit("now"))
    jobs = {r.job_name: r for r in rows.collect()}
    assert set(jobs) == {"j1", "j2"}
    assert {r.job_name: r.reason for r in refused.collect()} == {
        "j3": "no bucket in the ingestion path",
        "j4": "no ingestion config",
    }
    assert json.loads(jobs["j1"].s3_ingestion_config)["s3_event_name"] == "t1-event-forward-to--t1-ingestion-queue"
    assert json.loads(jobs["j1"].sqs)["DLQ_QUEUE_ARN"] == "arn:aws:sqs:us-east-1:1:t1-ingestion-queue-dlq"
    assert (jobs["j2"].active, jobs["j2"].created_by, jobs["j2"].cron_schedule) == ("False", "me", "0 1 * * ? *")
    assert jobs["j1"].cron_schedule == "0/15 * * * ? *"
    assert {r.job_name: r.state for r in activation_state(rows).collect()} == {"j1": "ENABLED", "j2": "DISABLED"}


def test_registering_and_resolving(spark):
    registry = spark.createDataFrame([], JOB_SCHEMA)
    jobs = spark.createDataFrame(
        [
            ("j1", "t1", "True", "2024-01-01", "x", "c", "{}", '{"q": "s", "x": "sqs"}', '{"x": "payload", "HUDI_METHOD": "insert"}'),
            ("j2", "t1", "True", "2024-01-02", "x", "c", "{}", "{}", '{"x": "second"}'),
        ],
        JOB_SCHEMA,
    )
    registry = register_jobs(register_jobs(registry, jobs), jobs)
    assert registry.count() == 2
    requests = spark.createDataFrame([(1, "j1", "t1"), (2, "none", "t1"), (3, "j1", "t2")], "id int, job_name string, table_name string")
    runs = resolve_runs(requests, registry).collect()
    assert [(r.id, r.arguments) for r in runs] == [(1, {"--q": "s", "--x": "sqs", "--HUDI_METHOD": "insert"})]
    loose = resolve_runs(requests, registry, match=("table_name",)).collect()
    assert sorted((r.id, r.arguments["--x"]) for r in loose) == [(1, "second"), (2, "second")]
    settings = effective_config(resolve_runs(requests, registry)).first()
    assert settings.hudi_method == "insert"
    assert settings.index_type == DEFAULTS["INDEX_TYPE"] and settings.job_name is None


def test_a_checkpoint_begun_anew_is_another_stream(spark, path):
    put(path, "raw/a.json", [{"customer_id": "1", "name": "x", "ts": "2024-01-05T00:00:00"}, {"name": "no key", "ts": "2024-01-05T00:00:00"}])
    c = config(path, operation="insert")
    for progress in ("first", "second"):
        drain_files(spark, c, path + "/raw", SCHEMA, f"{path}/{progress}")
    assert spark.read.json(c.target_path + "/_quarantine/rows").count() == 2
    assert target(spark, c).snapshot().count() == 2


def test_gone_objects_of_a_batch_are_set_aside(spark, path):
    name = put(path, "raw/a.json", [{"customer_id": "1", "name": "x", "ts": "2024-01-05T00:00:00"}])
    c = config(path)
    ingest_batch(spark, c, [name, f"{path}/raw/gone.json"], schema=SCHEMA)
    gone = spark.read.json(c.target_path + "/_quarantine/objects").collect()
    assert [(r.path, r._reason) for r in gone] == [(f"{path}/raw/gone.json", "object not found")]


def test_a_run_folds_the_change_log(spark, path):
    c = config(path, table_type="MERGE_ON_READ", log_commits=2)
    for i in range(4):
        ingest_frame(spark.createDataFrame([("1", str(i), f"2024-01-0{i + 1}T00:00:00")], SCHEMA), c)
    held = target(spark, c)
    assert len(held.version().of("log")) == 1 and [r.name for r in held.snapshot().collect()] == ["3"]
    assert [r.name for r in held.read_optimized().collect()] == ["2"]


def test_listing_takes_prefixes_literally(spark, path):
    for name in ("a[1]/x.json", "a1/x.json", "b/y.json"):
        put(path, f"raw/{name}", [{"customer_id": "1"}])
    assert [r.key for r in list_objects(spark, path + "/raw", "a[").collect()] == ["a[1]/x.json"]
    assert list_objects(spark, path + "/raw", "zzz").count() == 0


def test_every_document_is_an_object(spark, path):
    rows = [(i, f"src{i % 3}") for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(f"{path}/documents.parquet")
    found = QUERIES["list_object_keys"].run(spark, path).collect()
    assert sorted(r.folder for r in found) == sorted(f"arrival={source}/value={i}" for i, source in rows)
    assert all(r.objects == 1 and r.has_prefix == r.folder.startswith("arrival=src1/") for r in found)


def test_objects_are_laid_out_as_a_partitioned_write(spark, path):
    """On a local disk without a checksum file beside each object; elsewhere by Spark's writer."""
    names = ["a b", "a/b", "x=1", "", None, "50%", "__HIVE_DEFAULT_PARTITION__", "[q]{z}", "t\tu:v"]
    rows = [(name, i, i) for i, name in enumerate(names)] * 2 + [("s", None, None)]
    df = spark.createDataFrame(rows, "arrival string, value long, doc_id long")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.objects.link./at", f"file://{path}")

    def found(folder):
        lines = spark.read.option("recursiveFileLookup", "true").text(folder).select("_metadata.file_path", "value").collect()
        return sorted((r.file_path.split(folder.rpartition("/")[2] + "/")[1].rpartition("/")[0], r.value) for r in lines)

    df.repartition("arrival", "value").write.partitionBy("arrival", "value").json(f"{path}/spark")
    write_objects(df, f"{path}/own", ("arrival", "value"), 4)
    write_objects(df, "viewfs://objects/at/far", ("arrival", "value"), 4)
    assert found(f"{path}/own") == found(f"{path}/spark") == found(f"{path}/far") and len(found(f"{path}/own")) == len(rows)
    beside = [f for _, _, files in os.walk(f"{path}/own") for f in files if f.startswith(".")]
    assert beside == []


def test_a_listing_goes_in_groups(spark, path, monkeypatch):
    """The same objects in one group and in many, by few tasks, whatever the folders hold."""
    from tideloom.sources import files

    names = [f"a{i % 3}/b={i}/{'c/' * (i % 2)}x.json" for i in range(40)] + ["top.json", "a1/odd[1]{2}, \\d.json", "a1/_hidden/x.json", "a1/.x.json", "a1/_k=1/x.json"]
    for name in names:
        put(path, f"raw/{name}", [{"customer_id": "1"}])
    os.makedirs(f"{path}/raw/empty/below")
    shown = sorted(n for n in names if "_hidden" not in n and "/." not in n)

    def keys(prefix=""):
        return sorted(r.key for r in list_objects(spark, path + "/raw", prefix).collect())

    for many, group in ((256, 32768), (4, 7), (1, 1000), (256, 5)):
        monkeypatch.setattr(files, "MANY", many)
        monkeypatch.setattr(files, "GROUP", group)
        assert keys() == shown
        assert keys("a1") == [n for n in shown if n.startswith("a1")] and keys("a1/odd[1]") == ["a1/odd[1]{2}, \\d.json"]
    listed = list_objects(spark, path + "/raw")
    assert listed.columns == ["path", "key", "length", "modificationTime"] and list_objects(spark, f"{path}/raw/empty").isEmpty()


def test_objects_in_many_folders_are_read_by_few_tasks(spark, path):
    rows = [(i, f"src{i % 3}") for i in range(600)]
    write_objects(spark.createDataFrame(rows, "value long, arrival string"), f"{path}/raw", ("arrival", "value"), 4)
    group = f"objects-{path[-12:]}"
    spark.sparkContext.setJobGroup(group, "a listing")
    try:
        found = list_objects(spark, f"{path}/raw")
        assert found.count() == 600
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found.rdd.getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= 3 * spark.sparkContext.defaultParallelism


def test_batches_of_files_need_no_single_task(spark, path, monkeypatch):
    """The files of ``stream_batch_counts`` are dealt over tasks, one priority to a file."""
    from tideloom.queries import ingest

    rows = [(i, i % 7, "O", 1.0, dt.datetime(2024, 1, 1), f"{i % 5 + 1}-P") for i in range(100)]
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/orders.parquet")
    tasks = []
    write = ingest._write_json

    def noted(df, *more):
        tasks.append(df.select(F.spark_partition_id()).distinct().count())
        return write(df, *more)

    monkeypatch.setattr(ingest, "_write_json", noted)
    # Set without a lock: the stream's own thread writes with other settings.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert [tuple(r) for r in QUERIES["stream_batch_counts"].run(spark, path).collect()] == [(3, 2, 100)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks[0] > 1
