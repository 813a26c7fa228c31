import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from tideloom.functions.columns import SchemaConflict
from tideloom.operators import KeySpec
from tideloom.sinks import TableSpec, VersionedTable, register_table
from tideloom.sinks.table import MERGE_ON_READ, Batch, ConcurrentWrite, TableMismatch, VersionExpired

COLUMNS = "k int, o int, p string, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def spec(**options):
    table = {n: options.pop(n) for n in list(options) if n in ("table_type", "small_file_bytes", "max_file_bytes")}
    key = KeySpec(("k",), ("o",), options.pop("parts", ("p",)), **options)
    return TableSpec(key, codec="snappy", **table)


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def batch(rng, n, tag):
    return [
        (0 if rng.random() < 0.33 else rng.randrange(25), rng.randrange(1000), rng.choice([None, "a", "b/=%+ c"]), f"{tag}{i}")
        for i in range(n)
    ]


class Model:
    """The table as a Python list, to compare with."""

    def __init__(self, key):
        self.key, self.rows = key, []

    def scope(self, r):
        return (r[0],) if self.key.global_keys else (r[0], r[2])

    def top(self, rows):
        best = {}
        for r in rows:
            if self.scope(r) not in best or (r[1], r[2] is not None, r[2] or "", r[3]) > (
                lambda b: (b[1], b[2] is not None, b[2] or "", b[3])
            )(best[self.scope(r)]):
                best[self.scope(r)] = r
        return best

    def upsert(self, rows):
        for key, row in self.top(rows).items():
            held = [r for r in self.rows if self.scope(r) == key]
            if self.key.event_time and any(r[1] > row[1] for r in held):
                continue
            self.rows = [r for r in self.rows if self.scope(r) != key] + [row]

    def insert(self, rows):
        self.rows = self.rows + rows

    bulk_insert = insert

    def delete_keys(self, rows):
        gone = {self.scope(r) for r in rows}
        self.rows = [r for r in self.rows if self.scope(r) not in gone]

    def insert_if_absent(self, rows):
        held = {self.scope(r) for r in self.rows}
        self.rows = self.rows + [r for key, r in self.top(rows).items() if key not in held]

    def insert_overwrite(self, rows):
        self.delete_partition(rows)
        self.rows = self.rows + rows

    def insert_overwrite_table(self, rows):
        self.rows = list(rows)

    def delete_partition(self, rows):
        gone = {r[2] for r in rows}
        self.rows = [r for r in self.rows if r[2] not in gone]


STEPS = [
    ("upsert", 60),
    ("upsert", 20),
    ("insert", 15),
    ("upsert", 8),
    ("delete_keys", 3),
    ("upsert", 12),
    ("insert_if_absent", 20),
    ("bulk_insert", 9),
    ("upsert", 10),
    ("insert_overwrite", 2),
    ("upsert", 15),
    ("delete_partition", 1),
    ("upsert", 5),
]


@pytest.mark.parametrize(
    "table_type,global_keys,event_time", [("COPY_ON_WRITE", True, True), (MERGE_ON_READ, False, True)]
)
def test_operations_against_a_model(spark, path, table_type, global_keys, event_time):
    rng = random.Random(11)
    s = spec(global_keys=global_keys, event_time=event_time, table_type=table_type)
    table, model = VersionedTable(spark, path, s), Model(s.key)
    versions = {}
    for i, (operation, n) in enumerate(STEPS):
        rows = batch(rng, n, f"{i}.")
        getattr(table, operation)(frame(spark, rows))
        getattr(model, operation)(rows)
        assert sorted_rows(table.snapshot()) == sorted(model.rows, key=repr), (i, operation)
        versions[table.version().seq] = sorted(model.rows, key=repr)
    early = min(versions)
    assert sorted_rows(table.snapshot(as_of=early)) == versions[early]
    before = sorted_rows(table.snapshot())
    table.compact_log()
    assert sorted_rows(table.snapshot()) == sorted_rows(table.read_optimized()) == before
    table.expire(versions=2)
    table.compact_small_files()
    assert sorted_rows(table.snapshot()) == before
    table.insert_overwrite_table(frame(spark, rows))
    assert sorted_rows(table.snapshot()) == sorted(rows, key=repr)


def test_upsert_is_idempotent_and_touches_only_hit_files(spark, path):
    table = VersionedTable(spark, path, spec())
    table.upsert(frame(spark, [(i, 1, "abc"[i % 3], "x") for i in range(30)]))
    one = frame(spark, [(0, 2, "a", "new"), (99, 1, "b", "added")])
    table.upsert(one)
    changed = table.manifest().where("seq = 2 AND action = 'remove'")
    assert [r.part_key for r in changed.collect()] == ['{"p":"a"}']
    once = sorted_rows(table.snapshot())
    table.upsert(one)
    assert sorted_rows(table.snapshot()) == once
    assert len(once) == 31


def test_local_and_global_key_scope(spark, path):
    rows, moved = [(1, 1, "a", "x"), (2, 1, "a", "y")], [(1, 2, "b", "z")]
    local = VersionedTable(spark, path + "l", spec())
    world = VersionedTable(spark, path + "g", spec(global_keys=True))
    for table in (local, world):
        table.upsert(frame(spark, rows))
        table.upsert(frame(spark, moved))
    assert sorted_rows(local.snapshot()) == sorted(rows + moved)
    assert sorted_rows(world.snapshot()) == [(1, 2, "b", "z"), (2, 1, "a", "y")]


def test_late_rows_lose_in_event_time_only(spark, path):
    event = VersionedTable(spark, path + "e", spec(event_time=True))
    commit = VersionedTable(spark, path + "c", spec())
    for table in (event, commit):
        table.upsert(frame(spark, [(1, 5, "a", "old")]))
        table.upsert(frame(spark, [(1, 4, "a", "late")]))
    assert event.snapshot().first().v == "old"
    assert commit.snapshot().first().v == "late"
    event.upsert(frame(spark, [(1, 5, "a", "tie")]))
    assert event.snapshot().first().v == "tie"


def test_failed_commit_changes_nothing(spark, path, monkeypatch):
    table = VersionedTable(spark, path, spec())
    table.upsert(frame(spark, [(1, 1, "a", "x")]))
    before = sorted_rows(table.snapshot())

    def broken(*_):
        raise RuntimeError("lost between data and manifest")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_added", broken)
        with pytest.raises(RuntimeError):
            table.upsert(frame(spark, [(1, 2, "a", "y"), (2, 1, "b", "z")]))
    assert sorted_rows(table.snapshot()) == before
    assert len(glob.glob(f"{path}/data/_commit=*")) == 2
    table.upsert(frame(spark, [(1, 2, "a", "y")]))
    assert sorted_rows(table.snapshot()) == [(1, 2, "a", "y")]
    assert sorted(r.seq for r in table.history().collect()) == [1, 2]


def test_a_batch_is_applied_once(spark, path):
    table = VersionedTable(spark, path, spec())
    rows = frame(spark, [(1, 1, "a", "x")])
    assert table.insert(rows, stream_id="s", batch_id=0) == 1
    assert table.insert(rows, stream_id="s", batch_id=0) is None
    assert table.insert(rows, stream_id="t", batch_id=0) == 2
    assert table.snapshot().count() == 2


def test_schema_evolution_and_conflict(spark, path):
    table = VersionedTable(spark, path, spec())
    table.upsert(frame(spark, [(1, 1, "a", "x")]))
    table.upsert(spark.createDataFrame([(2, 1, "a", "y", 1.5)], COLUMNS + ", extra double"))
    table.upsert(frame(spark, [(3, 1, "b", "z")]))
    assert {(r.k, r.extra) for r in table.snapshot().collect()} == {(1, None), (2, 1.5), (3, None)}
    assert table.snapshot(as_of=1).columns == ["k", "o", "p", "v"]
    with pytest.raises(SchemaConflict):
        table.upsert(spark.createDataFrame([(1, "text", "a", "x")], "k int, o string, p string, v string"))
    assert table.version().seq == 3


def test_expired_files_go_and_old_versions_say_so(spark, path):
    table = VersionedTable(spark, path, spec(parts=()))
    for o in range(5):
        table.upsert(frame(spark, [(1, o, "a", f"v{o}")]))
    assert len(glob.glob(f"{path}/data/*/*.parquet")) == 5
    assert table.expire(versions=3) == 2
    assert len(glob.glob(f"{path}/data/*/*.parquet")) == 3
    assert table.snapshot().first().v == "v4"
    assert table.snapshot(as_of=3).first().v == "v2"
    with pytest.raises(VersionExpired):
        table.snapshot(as_of=2)
    assert table.expire(versions=3) == 0
    assert table.expire(commits=1) == 2
    with pytest.raises(ValueError):
        table.expire()


def test_folded_manifests_read_the_same(spark, path):
    table = VersionedTable(spark, path, spec(parts=(), table_type=MERGE_ON_READ))
    for o in range(3):
        table.upsert(frame(spark, [(1, o, "a", f"v{o}"), (o, 1, "a", "w")]))
    table.compact_log()
    rows, seen = sorted_rows(table.snapshot()), sorted_rows(table.snapshot(as_of=3))
    assert table.fold_manifests() == 0
    assert table.fold_manifests(at_least=2) == 4
    assert os.listdir(f"{path}/_manifest") == []
    assert sorted_rows(table.snapshot()) == rows and sorted_rows(table.snapshot(as_of=3)) == seen
    (ro, rt) = register_table(table, "views_db", "folded")
    assert sorted_rows(spark.table(ro)) == sorted_rows(spark.table(rt)) == rows
    table.insert(frame(spark, [(9, 9, "a", "x")]), stream_id="s", batch_id=1)
    table.expire(versions=1)
    assert table.fold_manifests(at_least=2) == 2
    assert table.has_batch("s", 1) and not table.has_batch("s", 2)
    assert table.snapshot().count() == len(rows) + 1
    assert sorted(r.seq for r in table.history().collect()) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(VersionExpired):
        table.snapshot(as_of=3)
    assert sorted_rows(table.snapshot(as_of=4)) == rows


def test_small_files_are_packed(spark, path):
    table = VersionedTable(spark, path, spec())
    for i in range(4):
        table.insert(frame(spark, [(i, 1, "a", "x"), (i, 1, f"p{i}", "y")]))
    before = sorted_rows(table.snapshot())
    assert table.compact_small_files() is not None
    assert sorted_rows(table.snapshot()) == before
    assert len(table.version().files) == 5
    assert table.compact_small_files() is None


def test_file_size_limit_bounds_rows_per_file(spark, path):
    table = VersionedTable(spark, path, spec(parts=(), max_file_bytes=2000))
    table.insert(frame(spark, [(i, 1, "a", "x") for i in range(100)]))
    table.insert(frame(spark, [(i, 1, "a", "x") for i in range(1000)]))
    assert len(table.version().files) > 3
    assert table.snapshot().count() == 1100


def test_bulk_insert_clusters_by_key(spark, path):
    table = VersionedTable(spark, path, spec(parts=(), max_file_bytes=4000))
    table.bulk_insert(frame(spark, [(0 if i % 3 == 0 else i, i, "a", f"{i:09d}" * 5) for i in range(3000)]))
    files = table.version().files
    assert len(files) > 4 and max(f.rows for f in files) < 1500  # the frequent key spreads over files
    table.upsert(frame(spark, [(2999, 1, "a", "new")]))
    assert table.manifest().where("seq = 2 AND action = 'remove'").count() == 1
    assert table.snapshot().count() == 3000


def test_empty_batches(spark, path):
    table = VersionedTable(spark, path, spec(event_time=True))
    none = frame(spark, [])
    assert table.delete_keys(none) is None and table.delete_partition(none) is None and not table.exists()
    table.upsert(none)
    assert table.snapshot().count() == 0
    table.upsert(frame(spark, [(1, 1, "a", "x")]))
    for operation in ("upsert", "insert", "delete_keys", "insert_overwrite", "delete_partition", "insert_if_absent"):
        getattr(table, operation)(none)
    assert sorted_rows(table.snapshot()) == [(1, 1, "a", "x")]


def test_text_and_composite_keys(spark, path):
    key = KeySpec(("a", "b"), ("o",), global_keys=True, event_time=True)
    table = VersionedTable(spark, path, TableSpec(key))
    make = lambda rows: spark.createDataFrame(rows, "a string, b date, o int")
    day = __import__("datetime").date
    table.upsert(make([(f"k{i}", day(2024, 1, 1 + i % 3), i) for i in range(1000)]))
    table.upsert(make([(f"k{i}", day(2024, 1, 1 + i % 3), i + (1 if i % 2 else -1)) for i in range(700)]))
    assert table.snapshot().agg(F.sum("o"), F.count("*")).first()[:] == (sum(range(1000)) + 350, 1000)


def test_two_commits_with_one_number_are_noticed(spark, path):
    table = VersionedTable(spark, path, spec())
    table.upsert(frame(spark, [(1, 1, "a", "x")]))
    os.makedirs(f"{path}/_manifest/commit=0000000001-other")
    source = glob.glob(f"{path}/_manifest/commit=*/part-*.json")[0]
    with open(source) as f, open(f"{path}/_manifest/commit=0000000001-other/part-0.json", "w") as g:
        g.write(f.read())
    with pytest.raises(ConcurrentWrite):
        table.snapshot()


def test_catalog_views_follow_the_table(spark, path):
    log = VersionedTable(spark, path + "m", spec(table_type=MERGE_ON_READ, event_time=True))
    log.upsert(frame(spark, [(1, 1, "a", "x"), (2, 5, "b/=%+ c", "y"), (3, 1, None, "n")]))
    log.upsert(frame(spark, [(1, 2, "a", "new"), (2, 4, "b/=%+ c", "late"), (3, 2, None, "m")]))
    ro, rt = register_table(log, "views_db", "t")
    assert sorted_rows(spark.table(ro)) == sorted_rows(log.read_optimized())
    assert sorted_rows(spark.table(rt)) == sorted_rows(log.snapshot())
    cow = VersionedTable(spark, path + "c", spec())
    cow.upsert(frame(spark, [(1, 1, "a", "x")]))
    register_table(cow, "views_db", "c")
    cow.upsert(frame(spark, [(1, 2, "a", "y"), (2, 2, "b", "z")]))
    (view,) = register_table(cow, "views_db", "c")
    assert sorted_rows(spark.table(view)) == [(1, 2, "a", "y"), (2, 2, "b", "z")]
    held = {r.partition for r in spark.sql("SHOW PARTITIONS views_db.c_base").collect()}
    assert held == {f.folder for f in cow.version().files} and not spark.catalog.tableExists("views_db.c_base_partly")


def test_catalog_view_of_partly_live_folders(spark, path):
    table = VersionedTable(spark, path, spec(parts=(), max_file_bytes=4000))
    table.bulk_insert(frame(spark, [(i, i, None, f"{i:09d}" * 5) for i in range(3000)]))
    table.upsert(frame(spark, [(5, 9999, None, "new")]))
    register_table(table, "views_db", "partly")
    (view,) = register_table(table, "views_db", "partly")
    assert spark.catalog.tableExists("views_db.partly_base_partly")
    assert sorted_rows(spark.table(view)) == sorted_rows(table.snapshot())


def test_changes_since(spark, path):
    table = VersionedTable(spark, path, spec())
    table.insert(frame(spark, [(1, 1, "a", "x")]))
    table.insert(frame(spark, [(2, 1, "a", "y")]))
    assert [r.k for r in table.changes_since(1).collect()] == [2]
    table.upsert(frame(spark, [(1, 2, "a", "z")]))
    with pytest.raises(ValueError, match="replaced"):
        table.changes_since(1)


def test_partitions_are_told_apart_to_the_microsecond_in_any_zone(spark, path):
    key = KeySpec(("k",), ("o",), ("t",))
    make = lambda rows: spark.createDataFrame(rows, "k int, o int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    table = VersionedTable(spark, path, TableSpec(key))
    table.upsert(make([(1, 1, "2024-01-01 00:00:00.001"), (2, 1, "2024-01-01 00:00:00.001001")]))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Lima")
        table.upsert(make([(1, 2, "2024-01-01 00:00:00.001")]))
        table.insert_overwrite(make([(3, 1, "2024-01-01 00:00:00.001")]))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted((r.k, r.t.microsecond) for r in table.snapshot().collect()) == [(2, 1001), (3, 1000)]
    for kind in ("timestamp", "double"):
        with pytest.raises(ValueError, match="partitioned by"):
            VersionedTable(spark, path + kind, TableSpec(key)).upsert(make([]).withColumn("t", F.lit(None).cast(kind)))


def test_layout_does_not_depend_on_the_broadcast(spark, path, monkeypatch):
    held = {n: spark.conf.get(n) for n in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    counts = []
    try:
        for limit in (64 << 20, 0):
            monkeypatch.setattr("tideloom.sinks.table.BROADCAST_BYTES", limit)
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            spark.conf.set("spark.sql.shuffle.partitions", "64")
            table = VersionedTable(spark, f"{path}{limit}", spec())
            rows = [(i, 1, f"p{i % 20}", "x") for i in range(2000)]
            table.upsert(frame(spark, rows))
            table.upsert(frame(spark, [(i, 2, f"p{i % 20}", "y") for i in range(0, 2000, 3)]))
            counts.append(len(table.version().files))
            assert sorted(map(tuple, table.snapshot().collect())) == [(k, 2 if k % 3 == 0 else 1, p, "y" if k % 3 == 0 else "x") for k, _, p, _ in rows]
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)
    assert counts == [20, 20]


def test_another_identity_is_refused(spark, path):
    VersionedTable(spark, path, spec()).upsert(frame(spark, [(1, 1, "a", "x")]))
    for other in (spec(global_keys=True), spec(parts=()), spec(table_type=MERGE_ON_READ)):
        with pytest.raises(TableMismatch):
            VersionedTable(spark, path, other).upsert(frame(spark, [(1, 1, "a", "x")]))


def test_second_writer_of_a_number_fails_and_the_table_lives(spark, path):
    table = VersionedTable(spark, path, spec())
    table.upsert(frame(spark, [(1, 1, "a", "x")]))
    stale = table.version()
    table.insert(frame(spark, [(2, 1, "a", "y")]))
    with pytest.raises(ConcurrentWrite):
        table.insert(frame(spark, [(3, 1, "a", "late")]), version=stale)
    os.makedirs(f"{path}/_claims", exist_ok=True)
    open(f"{path}/_claims/0000000003", "w").close()
    with pytest.raises(ConcurrentWrite):
        table.insert(frame(spark, [(3, 1, "a", "held")]))
    os.utime(f"{path}/_claims/0000000003", (0, 0))
    table.insert(frame(spark, [(3, 1, "a", "z")]))
    assert [r[0] for r in sorted_rows(table.snapshot())] == [1, 2, 3]
    assert table.remove_orphans(hours=24) == 0 and table.remove_orphans(hours=0) == 2
    assert [r[0] for r in sorted_rows(table.snapshot())] == [1, 2, 3]


def test_expiry_is_published_before_files_go(spark, path, monkeypatch):
    table = VersionedTable(spark, path, spec())
    for i in range(3):
        table.insert_overwrite_table(frame(spark, [(i, 1, "a", "x")]))
    monkeypatch.setattr(table._storage, "remove_all", lambda paths: (_ for _ in ()).throw(OSError("gone")) if list(paths) else 0)
    with pytest.raises(OSError):
        table.expire(versions=1)
    with pytest.raises(VersionExpired):
        table.snapshot(as_of=1)
    assert [r.k for r in table.snapshot().collect()] == [2]


def test_codec_and_sorted_ranges_of_bulk_insert(spark, path):
    import pyarrow.parquet as pq

    table = VersionedTable(spark, path, TableSpec(KeySpec(("k",), ("o",), ()), codec="gzip"))
    table.bulk_insert(frame(spark, [(i * 7 % 1000, 1, "a", "x") for i in range(1000)]).repartition(8))
    ranges = []
    for name in glob.glob(f"{path}/data/*/*.parquet"):
        file = pq.ParquetFile(name)
        assert file.metadata.row_group(0).column(0).compression == "GZIP"
        keys = file.read(["k"]).column(0).to_pylist()
        ranges.append((min(keys), max(keys)))
    ranges.sort()
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


def test_unknown_operation_and_type(spark, path):
    with pytest.raises(ValueError):
        VersionedTable(spark, path, spec()).write(frame(spark, []), "merge")
    with pytest.raises(ValueError):
        spec(table_type="OTHER")


def test_rows_that_could_not_be_read_back_are_refused(spark, path):
    table = VersionedTable(spark, path, spec())
    for row in ((None, 1, "a", "x"), (1, 1, "", "x")):
        with pytest.raises(Exception, match="null key|empty partition"):
            table.upsert(frame(spark, [row]))
    with pytest.raises(ValueError, match="lacks"):
        table.upsert(frame(spark, []).drop("o"))
    assert not table.exists()


def test_partition_values_keep_their_type_and_spelling(spark, path):
    day = __import__("datetime").date(2024, 2, 1)
    rows = [(1, 1, "007", day), (2, 1, "1e3", day), (3, 1, None, None)]
    key = KeySpec(("k",), ("o",), ("p", "d"))
    table = VersionedTable(spark, path, TableSpec(key))
    make = lambda r: spark.createDataFrame(r, "k int, o int, p string, d date")
    table.upsert(make(rows))
    table.upsert(make([(1, 2, "007", day), (3, 2, None, None)]))
    assert sorted_rows(table.snapshot()) == sorted([(1, 2, "007", day), (2, 1, "1e3", day), (3, 2, None, None)], key=repr)
    table.delete_partition(make([(0, 0, "1e3", day), (0, 0, None, None)]))
    assert sorted_rows(table.snapshot()) == [(1, 2, "007", day)]


def test_a_writing_task_gets_a_bounded_share(spark, path, monkeypatch):
    """One partition is written by several tasks, however large a file may be; their files are not packed again."""
    monkeypatch.setattr("tideloom.sinks.table.WRITE_BYTES", 100_000)
    monkeypatch.setattr("tideloom.sinks.table.PACKED_BYTES", 6_000)
    table = VersionedTable(spark, path, spec())
    wide = spark.range(0, 20_000, 1, 8).selectExpr("int(id) AS k", "1 AS o", "'a' AS p", "sha2(string(id), 256) AS v")
    table.insert(wide)
    files = {f.path for f in table.version().files}
    assert len(files) > 4
    table.insert(frame(spark, [(-1, 1, "a", "x")]))
    assert files < {f.path for f in table.version().files} and table.snapshot().count() == 20_001


def test_large_key_sides_do_not_pass_through_the_driver(spark, path):
    table = VersionedTable(spark, path, spec())
    hinted = lambda need: "hint" in table._key_side(frame(spark, []), Batch(frame(spark, []), 0, need, None, None, frozenset()))._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(1 << 20) and not hinted(16 << 20)
