"""Delivery at least once, the message folder, drifting types and the curve layout."""

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.operators import KeySpec, bulk_insert, z_order
from tideloom.operators.clustering import bin_numbers
from tideloom.plans import IngestConfig
from tideloom.sinks import VersionedTable
from tideloom.sources import read_drifting, read_messages
from tideloom.sources.drift import held_type
from tideloom.streaming import count_receives, drain_messages, drain_receipts, once

RECEIPTS = "message_id string, body string, at timestamp"


def moment(hours):
    return None if hours is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def arrive(spark, path, rows, schema=RECEIPTS):
    spark.createDataFrame([(m, b, moment(h)) for m, b, h in rows], schema).coalesce(1).write.mode("append").parquet(path)


def through(spark, path, batches, make):
    """The rows that ``make`` gives out for each batch of receipts, over one checkpoint."""
    out = []
    for rows in batches:
        arrive(spark, f"{path}/in", rows)
        seen = []
        query = make(spark.readStream.schema(RECEIPTS).parquet(f"{path}/in")).writeStream.foreachBatch(lambda b, n, seen=seen: seen.extend(b.collect()))
        query.option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
        out.append(seen)
    return out


def test_copies_across_batches_go(spark, path):
    batches = [[("a", "1", 1), ("a", "1", 1), ("b", "2", 1), (None, "x", 1)], [("a", "1", 1.5), ("c", "3", 2), (None, "x", 2), (None, "y", 2)], [("d", "4", 30)], [("a", "late", 2), ("a", "again", 31)]]
    found = through(spark, path, batches, lambda s: once(s, "message_id", "at", "2 hours", body="body"))
    assert [sorted((r.message_id or "", r.body) for r in b) for b in found] == [[("", "x"), ("a", "1"), ("b", "2")], [("", "y"), ("c", "3")], [("d", "4")], [("a", "again")]]


def test_copies_of_a_batch_go(spark):
    frame = spark.createDataFrame([("a", "1"), ("a", "2"), (None, "x"), (None, "x"), (None, None)], "message_id string, body string")
    assert once(frame, body="body").count() == 3 and once(frame.where("false")).count() == 0


def test_receives_are_counted_across_batches(spark, path):
    batches = [
        [("a", "1", 1), ("b", "2", 1), ("b", "2", 2)], [("a", "1", 3), ("b", "2", 3), ("c", None, 3)], [("a", "1", 4), ("a", "1", 3.5), (None, "x", 4)],
        [("z", "", 40)], [("a", "1", 41), (None, "x", 41), ("z", "", 41)],
    ]
    found = through(spark, path, batches, lambda s: count_receives(s, "message_id", "at", limit=2, keep="12 hours", body="body"))
    seen = [sorted((r.message_id or "", (r.at - moment(0)).total_seconds() / 3600, r.receives, r.action) for r in b) for b in found]
    assert seen == [
        [("a", 1, 1, "deliver"), ("b", 1, 1, "deliver"), ("b", 2, 2, "deliver")],
        [("a", 3, 2, "deliver"), ("b", 3, 3, "dead letter"), ("c", 3, 1, "deliver")],
        [("", 4, 1, "deliver"), ("a", 3.5, 3, "dead letter"), ("a", 4, 4, "gone")],
        [("z", 40, 1, "deliver")],
        [("", 41, 1, "deliver"), ("a", 41, 1, "deliver"), ("z", 41, 2, "deliver")],
    ]


def objects(path, names):
    os.makedirs(f"{path}/raw", exist_ok=True)
    for name in names:
        with open(f"{path}/raw/{name}.json", "w") as f:
            f.write(json.dumps({"k": name, "v": 1}) + "\n")
    return {n: json.dumps({"Records": [{"s3": {"bucket": {"name": "b"}, "object": {"key": f"{n}.json"}}}]}) for n in names}


def inserting(path):
    return IngestConfig(target_path=f"{path}/target", record_key=("k",), ordering=("v",), operation="insert")


OPTIONS = {"schema": T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])}


def test_a_message_that_keeps_coming_is_set_aside(spark, path):
    body = objects(path, "ab")
    config = inserting(path)
    for hour, names in enumerate(["ab", "a", "a"], 1):
        arrive(spark, f"{path}/in", [(n, body[n], hour) for n in names])
        stream = spark.readStream.schema(RECEIPTS).parquet(f"{path}/in")
        drain_receipts(stream, config, f"{path}/progress", received_at="at", path_template=f"{path}/raw%.0s/%s", **OPTIONS)
    assert sorted(r.k for r in VersionedTable(spark, config.target_path, config.table).snapshot().collect()) == ["a", "b"]
    letters = spark.read.json(f"{config.target_path}/_quarantine/dead_letters").collect()
    assert [(r.message_id, r.receives) for r in letters] == [("a", 2)]


def put(path, name, lines):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/.{name}", "w") as f:
        f.write("".join(line + "\n" for line in lines))
    os.rename(f"{path}/.{name}", f"{path}/{name}")
    time.sleep(0.02)


def polled(spark, path, cap):
    seen = []
    query = read_messages(spark, f"{path}/queue", cap).writeStream.foreachBatch(lambda b, n: seen.append((n, [r.body for r in b.orderBy("body").collect()])))
    query = query.option("checkpointLocation", f"{path}/progress").trigger(processingTime="0 seconds").start()
    query.processAllAvailable()
    query.stop()
    return [x for x in seen if x[1]]


def test_a_message_folder_goes_on_where_it_stopped(spark, path):
    message = lambda i: json.dumps({"message_id": f"m{i}", "sent_at": "2024-01-01T00:00:00Z", "body": f"b{i}"})
    put(f"{path}/queue", "z", [message(i) for i in range(5)])
    put(f"{path}/queue", "a", ["junk", json.dumps({"body": 1}), message(6)])
    put(f"{path}/queue", "empty", [])
    assert [b for _, b in polled(spark, path, 3)] == [["b0", "b1", "b2"], ["b3", "b4", "junk"], ["b6", '{"body": 1}']]
    assert polled(spark, path, 3) == []
    put(f"{path}/queue", "b", [message(i) for i in (7, 8, 9)])
    assert [b for _, b in polled(spark, path, 2)] == [["b7", "b8"], ["b9"]]


def test_an_absent_message_folder_is_empty(spark, path):
    assert polled(spark, path, 3) == []


def test_messages_of_a_folder_are_applied_once(spark, path):
    body = objects(path, "abc")
    config = inserting(path)
    for turn in range(2):
        put(f"{path}/queue", f"f{turn}", [json.dumps({"message_id": n, "sent_at": "2024-01-01T00:00:00Z", "body": b}) for n, b in body.items()])
        stream = read_messages(spark, f"{path}/queue", 2)
        drain_messages(stream, config, f"{path}/progress", message_id="message_id", until_empty=True, path_template=f"{path}/raw%.0s/%s", **OPTIONS)
    assert sorted(r.k for r in VersionedTable(spark, config.target_path, config.table).snapshot().collect()) == ["a", "b", "c"]


def test_drifting_records_keep_every_field(spark, path):
    lines = [
        '{"a": 1, "b": "x", "c": {"d": 1, "e": [1, 2]}, "n": null, "big": 123456789012345678901234}', '{"a": 2.5, "b": 7, "c": {"d": "t"}, "q r`s,": true, "x\'y": "2024-01-01"}',
        "not json", "[1]", "", "   ", '{"a": 1, "a": 2}', '{"a": 1e3, "b": {"z": [1, "x"]}, "arr": [{"k": 1}, {"k": 2.5}]}', "{}", "null",
    ]
    put(f"{path}/raw", "a.json", lines[:4])
    put(f"{path}/raw", "b.json", lines[4:])
    found = read_drifting(spark, [f"{path}/raw", f"{path}/raw"])
    kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    assert kinds == {
        "a": "double", "arr": "array<struct<k:double>>", "b": "string", "big": "double", "c": "struct<d:string,e:array<bigint>>", "n": "string",
        "q r`s,": "boolean", "x'y": "string", "_corrupt_record": "string",
    }
    rows = found.collect()
    assert sorted(r._corrupt_record for r in rows if r._corrupt_record) == sorted([lines[2], lines[3], lines[6], lines[9]])
    good = sorted((r.a, r.b) for r in rows if r.a is not None)
    assert good == [(1.0, "x"), (2.5, "7"), (1000.0, '{"z":[1,"x"]}')] and len(rows) == 8
    assert [r.c.d for r in rows if r.c] == ["1", "t"] or [r.c.d for r in rows if r.c] == ["t", "1"]


def test_drifting_records_of_nothing(spark, path):
    put(f"{path}/raw", "a.json", ["", "{}"])
    assert read_drifting(spark, [f"{path}/raw"]).columns == []
    put(f"{path}/bad", "a.json", ["x", "y"])
    assert [r._corrupt_record for r in read_drifting(spark, [f"{path}/bad"]).orderBy("_corrupt_record").collect()] == ["x", "y"]


@pytest.mark.parametrize(
    ("schema", "kind"),
    [("BIGINT", "bigint"), ("DECIMAL(3,1)", "double"), ("DECIMAL(24,0)", "double"), ("VOID", "string"), ("VARIANT", "string"), ("ARRAY<OBJECT<a: BIGINT, `b,c`: ARRAY<VOID>>>", "array<struct<a:bigint,b,c:array<string>>>"), ("OBJECT<>", "string")],
)
def test_types_of_variant_schemas(schema, kind):
    assert held_type(schema).simpleString() == kind


def test_bins_by_brute_force(spark):
    values = [None, float("nan"), -5.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 1e300, float("inf")]
    rows = [(i, v, dt.date(2024, 1, 1 + i), ["", "aa", "ab", "b", "é", None, "zzzzzzzz"][i % 7]) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "i int, v double, d date, `s.t` string")
    found = frame.select("i", *[c.alias(f"n{k}") for k, c in enumerate(bin_numbers(frame, ("v", "d", "s.t"), 2))]).orderBy("i").collect()
    assert found[0].n0 == 0 and [r.n0 for r in found[3:8]] == [found[3].n0] * 5 and found[1].n0 == max(r.n0 for r in found)
    order = sorted((r for r in found if r.i not in (0, 1)), key=lambda r: values[r.i])
    assert [r.n0 for r in order] == sorted(r.n0 for r in order) and [r.n1 for r in found] == sorted(r.n1 for r in found) and found[-1].n1 == 3
    texts = sorted((rows[r.i][3].encode(), r.n2) for r in found if rows[r.i][3] is not None)
    assert [n for _, n in texts] == sorted(n for _, n in texts)


def test_places_interleave_the_bins(spark):
    frame = spark.range(64).selectExpr("id % 8 AS x", "id div 8 AS y")
    for r in z_order(frame, ("x", "y"), bits=3).collect():
        assert r.z == sum(((r.x >> b & 1) << 2 * b + 1) + ((r.y >> b & 1) << 2 * b) for b in range(3))
    with pytest.raises(ValueError):
        z_order(frame, ())
    assert z_order(frame.where("false"), ("x",)).count() == 0


def test_clustered_files_are_narrow_in_every_column(spark, path):
    frame = spark.range(40_000).selectExpr("xxhash64(id) % 1000 AS k", "xxhash64(id, 1) % 1000 AS w", "id AS k2")
    spec = KeySpec(("k",), ())

    def widths(rows, name):
        rows.write.parquet(f"{path}/{name}")
        files = spark.read.parquet(f"{path}/{name}").groupBy(F.col("_metadata.file_path")).agg((F.max("k") - F.min("k")).alias("k"), (F.max("w") - F.min("w")).alias("w"))
        return files.agg(F.avg("k").alias("k"), F.avg("w").alias("w"), F.count("*").alias("n")).first()

    by_key, along = widths(bulk_insert(frame, spec, 16), "key"), widths(bulk_insert(frame, spec, 16, ("k", "w")), "curve")
    assert by_key.n == along.n == 16 and along.w < 0.5 * by_key.w and along.k < 0.5 * 2000
    hot = frame.withColumn("k", F.lit(1).cast("long")).withColumn("w", F.lit(1).cast("long"))
    assert widths(bulk_insert(hot, spec, 16, ("k", "w")), "hot").n == 16


def test_messages_share_the_state_of_a_bucket(spark, path, monkeypatch):
    """Three hundred messages, four calls a micro-batch; each is counted and forgotten on its own."""
    monkeypatch.setattr("tideloom.streaming.receipts.BUCKETS", 4)
    batches = [[(f"m{i}", "", 1 + i / 100) for i in range(300)], [(f"m{i}", "", 6) for i in range(0, 300, 3)], [("z", "", 14)], [(f"m{i}", "", 15) for i in range(300)]]
    seen, kept = [], []
    for rows in batches:
        arrive(spark, f"{path}/in", rows)
        stream = count_receives(spark.readStream.schema(RECEIPTS).parquet(f"{path}/in"), "message_id", "at", limit=2, keep="10 hours")
        query = stream.writeStream.foreachBatch(lambda b, n: seen.extend(b.collect())).option("checkpointLocation", f"{path}/progress")
        query = query.trigger(availableNow=True).start()
        query.awaitTermination()
        kept.append(query.recentProgress[-1].stateOperators[0].numRowsTotal)
    found = {}
    for r in seen:
        found.setdefault(r.message_id, []).append(r.receives)
    # After fifteen hours only what came five hours or more after the start is still the same message.
    assert found == {"z": [1]} | {f"m{i}": [1, 2, 3] if i % 3 == 0 else [1, 2 if 15 - (1 + i / 100) <= 10 else 1] for i in range(300)}
    assert max(kept) <= 4
