"""A keyed, partitioned table of Parquet files with versions.

Layout under the table's root::

    data/_commit=<seq>-<attempt>/<partition>=<value>/part-*.parquet
    _manifest/commit=<seq>-<attempt>/part-*.json
    _folded/upto=<seq>-<attempt>/part-*.parquet

A commit first writes data files into a folder of its own and then one manifest
file, whose appearance is the atomic point: data that no manifest names is
invisible. A manifest has a ``commit`` row (operation, schema, batch identity)
and one row per data file added or removed. A file belongs to a version if it
was added at or before it and not removed by then.

Manifests of old commits are folded into one set of files from time to time.

An upsert rewrites only the files that hold a replaced row. What reaches the
driver is file addresses, never table rows. One writer at a time is assumed.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import conform_to, merged_schema
from ..operators.keyspec import KeySpec
from ..operators.merge import _IN, beats_incoming, bulk_insert, keyed_side, merge_upsert, surviving
from ..operators.precombine import precombine
from ..operators.retention import expirable_by_commits, expirable_by_versions, small_file_candidates
from ..workspace import fresh_path, setting
from .storage import Storage

# Table types, operations and file sizes.
COPY_ON_WRITE = "COPY_ON_WRITE"
MERGE_ON_READ = "MERGE_ON_READ"
OPERATIONS = (
    "upsert",
    "insert",
    "bulk_insert",
    "insert_if_absent",
    "delete",
    "insert_overwrite",
    "insert_overwrite_table",
    "delete_partition",
)
# Operations after which a key may occur more than once.
MAY_REPEAT_KEYS = ("insert", "bulk_insert", "insert_overwrite", "insert_overwrite_table")
MAX_FILE_BYTES = 512 * 1024 * 1024
SMALL_FILE_BYTES = 104857600

# A side of a join is broadcast up to this size, measured on the rows themselves. It passes
# through the driver, where its hash table takes several times as much.
BROADCAST_BYTES = 8 * 1024 * 1024
# What a writing task gets to sort, in bytes as shuffled (Spark's own default): in memory they
# are several times as many.
WRITE_BYTES = 64 * 1024 * 1024
# Up to this many distinct keys the key lookup lists them in its filter, which
# row-group statistics and bloom filters can then use.
LISTED_KEYS = 500

# Small files that a partition may keep before the next write packs them, and the operations that do so.
# A file that a full writing task made does not count: packing would write it again as it is.
SMALL_FILES_KEPT = 4
PACKED_BYTES = WRITE_BYTES // 16
PACKING = ("upsert", "insert", "insert_if_absent", "delete")
# How long a writer may take to write a manifest before its claim counts as abandoned.
CLAIM_SECONDS = 3600
# Change-log commits that a run leaves before it folds them into the base files.
LOG_COMMITS = 5

# How many separate manifests are read before they are folded.
FOLD_AFTER = 100
FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
# Partition types whose text is exact and does not depend on the session's time zone.
PARTITION_TYPES = (T.IntegralType, T.DecimalType, T.StringType, T.BooleanType, T.DateType, T.TimestampNTZType)
# Key types whose values can stand in a filter exactly as read.
PRUNABLE = (T.IntegralType, T.DecimalType, T.StringType, T.DateType)
COMMIT_COLUMN = "_commit"
_FILE = "__file"
_MARKER = f"/data/{COMMIT_COLUMN}="

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("kind", T.StringType()),  # commit, base, log, horizon
        T.StructField("action", T.StringType()),  # add, remove, expire
        T.StructField("part_key", T.StringType()),  # partition values as JSON
        T.StructField("folder", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("operation", T.StringType()),
        T.StructField("stream_id", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("committed_at", T.StringType()),
        T.StructField("table_schema", T.StringType()),
        T.StructField("identity", T.StringType()),  # key, scope, partitions and type, as JSON
    ]
)


@dataclass(frozen=True)
class TableSpec:
    """Identity of the rows plus the physical options of the table."""

    key: KeySpec
    table_type: str = COPY_ON_WRITE
    codec: str = "gzip"
    max_file_bytes: int = MAX_FILE_BYTES
    small_file_bytes: int = SMALL_FILE_BYTES
    key_bloom: bool = True
    # Columns along whose curve a bulk insert lays out its rows, instead of by key.
    cluster_by: tuple[str, ...] = ()

    def __post_init__(self):
        if self.table_type not in (COPY_ON_WRITE, MERGE_ON_READ):
            raise ValueError(f"unknown table type {self.table_type}")


@dataclass(frozen=True)
class DataFile:
    path: str  # below data/
    folder: str
    kind: str
    part_key: str | None
    rows: int
    bytes: int
    whole_folder: bool  # every file ever added to the folder is live


@dataclass
class Version:
    """What the manifest says about the table as of one commit."""

    seq: int = 0
    schema: T.StructType | None = None
    files: list[DataFile] = field(default_factory=list)
    unique_keys: bool = True  # only operations that keep keys unique so far
    has_batch: bool = False  # the batch asked about has been applied
    identity: str | None = None

    def of(self, kind: str) -> list[DataFile]:
        return [f for f in self.files if f.kind == kind]


@dataclass(frozen=True)
class Batch:
    """A staged batch and what was observed while it was written."""

    data: DataFrame
    rows: int
    bytes: int  # memory need of the key and ordering columns, at most
    low: object
    high: object
    part_keys: frozenset[str | None]


class ConcurrentWrite(RuntimeError):
    """Two commits carry the same sequence number."""


class TableMismatch(ValueError):
    """A write asks for another key, partitioning or type than the table was created with."""


class VersionExpired(ValueError):
    """Files of the requested version have been removed."""


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, spec: TableSpec):
        self.spark = spark
        self.root = root.rstrip("/")
        self.spec = spec
        self.key = spec.key
        self._storage = Storage(spark)

    # ---- manifest -------------------------------------------------------

    @property
    def data_root(self) -> str:
        return f"{self.root}/data"

    @property
    def manifest_root(self) -> str:
        return f"{self.root}/_manifest"

    @property
    def identity(self) -> str:
        """What every write to the table must agree on; orderings and file sizes may change."""
        held = {"keys": self.key.keys, "parts": self.key.parts, "global": self.key.global_keys, "type": self.spec.table_type}
        return json.dumps(held, sort_keys=True)

    @property
    def _write_bytes(self) -> int:
        return min(self.spec.max_file_bytes, WRITE_BYTES)

    def exists(self) -> bool:
        return self._storage.exists(self.manifest_root)

    def manifest(self, as_of: int | None = None) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        rows = self.spark.read.schema(MANIFEST_SCHEMA).json(self.manifest_root).select(*MANIFEST_SCHEMA.names)
        upto, path = self.folded()
        if path:
            older = self.spark.read.schema(MANIFEST_SCHEMA).parquet(path)
            rows = rows.where(F.col("seq") > upto).unionByName(older)
        return rows if as_of is None else rows.where(F.col("seq") <= as_of)

    def folded(self) -> tuple[int, str | None]:
        """Up to which commit manifests have been folded, and where they are."""
        root = f"{self.root}/_folded"
        for name in reversed(self._storage.children(root)):
            if name.startswith("upto=") and self._storage.exists(f"{root}/{name}/_SUCCESS"):
                return _seq_of(name), f"{root}/{name}"
        return 0, None

    def history(self) -> DataFrame:
        return self.manifest().where(F.col("kind") == "commit").drop("kind", "action", "part_key", "folder", "file")

    def file_lives(self, as_of: int | None = None) -> DataFrame:
        """One row per data file: the commits that added, removed and expired it."""
        return _lives(self.manifest(as_of).where(F.col("kind").isin("base", "log")))

    def version(
        self, as_of: int | None = None, stream_id: str | None = None, batch_id: int | None = None
    ) -> Version:
        if not self.exists():
            return Version()
        asked = (F.col("stream_id") == F.lit(stream_id)) & (F.col("batch_id") == F.lit(batch_id).cast("long"))
        # One shuffle by folder serves the file lives, the check for whole
        # folders, and (their folder being null) the commit rows.
        entries = self.manifest(as_of).repartition("folder")
        latest = F.max_by(F.struct("seq", "table_schema", "identity"), "seq")
        repeats = F.max(F.col("operation").isin(*MAY_REPEAT_KEYS)).alias("repeats")
        seqs = F.size(F.collect_set("seq")).alias("seqs")
        gone = F.col("removed").isNotNull()
        lives = (
            _lives(entries, latest.alias("latest"), F.count("*").alias("entries"), seqs, repeats, F.max(asked).alias("asked"))
            .withColumn("whole", ~F.max(gone).over(Window.partitionBy("folder")))
            .where(F.col("kind").isin("commit", "horizon") | ~gone)
            .collect()
        )
        header = next((r for r in lives if r.kind == "commit"), None)
        if header is None:
            return Version()
        if header.entries != header.seqs:
            raise ConcurrentWrite(f"{self.root}: two commits have the same number")
        files = [
            DataFile(f"{r.folder}/{r.file}", r.folder, r.kind, r.part_key, r.rows, r.bytes, r.whole)
            for r in lives
            if r.kind in ("base", "log")
        ]
        if as_of is not None:
            if not self.manifest().where((F.col("kind") == "horizon") & (F.col("seq") > as_of)).isEmpty():
                raise VersionExpired(f"{self.root}: version {as_of} is no longer retained")
            expired = self.file_lives().where(F.col("expired").isNotNull())
            if not expired.where((F.col("added") <= as_of) & (F.col("removed") > as_of)).isEmpty():
                raise VersionExpired(f"{self.root}: version {as_of} is no longer retained")
        schema = T.StructType.fromJson(json.loads(header.latest.table_schema))
        return Version(header.latest.seq, schema, files, not header.repeats, bool(header.asked), header.latest.identity)

    def has_batch(self, stream_id: str | None, batch_id: int | None) -> bool:
        if stream_id is None or batch_id is None:
            return False
        return self.version(stream_id=stream_id, batch_id=batch_id).has_batch

    # ---- reads ----------------------------------------------------------

    def snapshot(self, as_of: int | None = None) -> DataFrame:
        """All rows of a version: base files with the change log merged in."""
        version = self.version(as_of)
        base = self._rows(version, version.of("base"))
        log = version.of("log")
        if not log:
            return base
        return merge_upsert(
            base,
            self._latest_changes(version, log),
            self.key,
            unique_incoming=True,
            unique_current=version.unique_keys,
            small_incoming=self._fits_broadcast(version, log),
        )

    def read_optimized(self, as_of: int | None = None) -> DataFrame:
        """The rows as of the last compaction: base files only."""
        version = self.version(as_of)
        return self._rows(version, version.of("base"))

    def changes_since(self, seq: int) -> DataFrame:
        """Rows added after a commit, where every commit since has only added files; otherwise an error."""
        if not self.manifest().where((F.col("seq") > seq) & (F.col("action") == "remove")).isEmpty():
            raise ValueError(f"{self.root}: a commit after {seq} replaced files, so that they hold older rows too")
        version = self.version()
        return self._rows(version, [f for f in version.files if _seq_of(f.folder) > seq])

    def _scan(self, version: Version, files: Sequence[DataFile]) -> DataFrame:
        """The files' rows with their commit folder and file address."""
        schema = self._schema_of(version)
        parts = set(self.key.parts)
        stored = [f for f in schema.fields if f.name not in parts]
        layout = [T.StructField(COMMIT_COLUMN, T.StringType()), *(f for f in schema.fields if f.name in parts)]
        paths = {f.folder if f.whole_folder else f.path for f in files}
        return (
            self.spark.read.schema(T.StructType([*stored, *layout]))
            .option("basePath", self.data_root)
            .parquet(*sorted(f"{self.data_root}/{path}" for path in paths))
        )

    def _rows(self, version: Version, files: Sequence[DataFile]) -> DataFrame:
        schema = self._schema_of(version)
        if not files:
            return self.spark.createDataFrame([], schema)
        return self._scan(version, files).select(*[F.col(f"`{name}`") for name in schema.names])

    def _latest_changes(self, version: Version, log: Sequence[DataFile]) -> DataFrame:
        """The change of each key that decides its merged state."""
        number = F.split(F.col(COMMIT_COLUMN), "-")[0].cast("long").desc()
        changes = self._scan(version, log)
        if self.key.event_time:
            latest = precombine(changes, self.key, tiebreak=[number])
        else:
            latest = precombine(changes, self.key, leading=[number], tiebreak=[])
        return latest.select(*[F.col(f"`{name}`") for name in version.schema.names])

    def _fits_broadcast(self, version: Version, log: Sequence[DataFile]) -> bool:
        """Whether the log's key columns fit a broadcast: by its row count, or measured if keys are text."""
        schema = self._schema_of(version)
        names = list(dict.fromkeys((*self.key.scope, *self.key.ordering)))
        if all(isinstance(schema[n].dataType, FIXED_WIDTH) for n in names):
            return sum(f.rows for f in log) * (32 + 16 * len(names)) <= BROADCAST_BYTES
        need = _row_bytes([schema[n] for n in names])
        return (self._rows(version, log).agg(F.sum(need)).first()[0] or 0) <= BROADCAST_BYTES

    def _schema_of(self, version: Version) -> T.StructType:
        if version.schema is None:
            raise ValueError(f"{self.root}: no such table")
        return version.schema

    # ---- writes ---------------------------------------------------------

    def write(self, df: DataFrame, operation: str = "upsert", **batch) -> int | None:
        """Apply one operation with ``df`` as its batch; see the methods of the same name."""
        if operation not in OPERATIONS:
            raise ValueError(f"unknown operation {operation}; expected one of {OPERATIONS}")
        method = self.delete_keys if operation == "delete" else getattr(self, operation)
        return method(df, **batch)

    def upsert(self, df: DataFrame, **batch) -> int | None:
        def plan(version: Version, rows: DataFrame, work: _Work):
            if version.schema is None or not version.files:
                return self._commit(version, precombine(rows, self.key), **work.identity("upsert"))
            if self.spec.table_type == MERGE_ON_READ:
                return self._commit(version, precombine(rows, self.key), kind="log", **work.identity("upsert"))
            return self._merge(version, self._staged(work, precombine(rows, self.key)), work, "upsert")

        return self._apply(df, plan, batch)

    def insert(self, df: DataFrame, **batch) -> int | None:
        def plan(version: Version, rows: DataFrame, work: _Work):
            version = self._without_log(version)
            return self._commit(version, rows, **work.identity("insert"))

        return self._apply(df, plan, batch)

    def bulk_insert(self, df: DataFrame, **batch) -> int | None:
        def plan(version: Version, rows: DataFrame, work: _Work):
            version = self._without_log(version)
            # Finding the ranges reads the rows a second time, so they are staged; that also tells their size.
            staged, _ = work.stage(rows, F.count(F.lit(1)).alias("rows"))
            rows = bulk_insert(staged, self.key, self._ranges(staged), self.spec.cluster_by)
            return self._commit(version, rows, cluster=False, **work.identity("bulk_insert"))

        return self._apply(df, plan, batch)

    def insert_if_absent(self, df: DataFrame, **batch) -> int | None:
        def plan(version: Version, rows: DataFrame, work: _Work):
            version = self._without_log(version)
            rows = precombine(rows, self.key)
            if version.files:
                batch = self._staged(work, rows)
                rows, files = batch.data, self._candidates(version, batch)
                if files and batch.rows:
                    keys = self._key_side(rows, batch)
                    held = self._lookup(version, files, batch).join(keys, self.key.same_scope(_IN), "left_semi")
                    rows = surviving(rows, keyed_side(held.select(*self.key.scope).distinct(), self.key), self.key)
            return self._commit(version, rows, **work.identity("insert_if_absent"))

        return self._apply(df, plan, batch)

    def delete_keys(self, df: DataFrame, **batch) -> int | None:
        def plan(version: Version, rows: DataFrame, work: _Work):
            version = self._without_log(version)
            if not version.files:
                return self._commit(version, None, **work.identity("delete"))
            keys = self._staged(work, rows.select(*self.key.scope).distinct())
            return self._merge(version, keys, work, "delete", store=False)

        return self._apply(df, plan, batch, evolve=False)

    def insert_overwrite(self, df: DataFrame, **batch) -> int | None:
        def plan(version: Version, rows: DataFrame, work: _Work):
            version = self._without_log(version)
            batch = self._staged(work, rows)
            replaced = [f for f in version.files if f.part_key in batch.part_keys]
            return self._commit(version, batch.data, removed=replaced, **work.identity("insert_overwrite"))

        return self._apply(df, plan, batch)

    def insert_overwrite_table(self, df: DataFrame, **batch) -> int | None:
        def plan(version: Version, rows: DataFrame, work: _Work):
            return self._commit(version, rows, removed=version.files, **work.identity("insert_overwrite_table"))

        return self._apply(df, plan, batch)

    def delete_partition(self, df: DataFrame, **batch) -> int | None:
        """Drop the partitions listed in ``df``; no data file is read or written."""

        def plan(version: Version, rows: DataFrame, work: _Work):
            version = self._without_log(version)
            listed = {r[0] for r in rows.select(self._part_key()).distinct().collect()}
            dropped = [f for f in version.files if f.part_key in listed]
            return self._commit(version, None, removed=dropped, **work.identity("delete_partition"))

        return self._apply(df, plan, batch, evolve=False)

    def compact_log(self, at_least: int = 1) -> int | None:
        """Fold the change log into the base files, once it has so many commits."""
        version = self.version()
        log = version.of("log")
        if len({_seq_of(f.folder) for f in log}) < at_least:
            return None
        with _Work(self.spark, self._storage) as work:
            changes = self._staged(work, self._latest_changes(version, log))
            return self._merge(version, changes, work, "compact", also_removed=log)

    def compact_small_files(self) -> int | None:
        """Rewrite the small files of each partition that has several; the rows stay the same."""
        version = self.version()
        listed = self.file_lives().where(F.col("removed").isNull() & (F.col("kind") == "base"))
        chosen = {
            f"{r.folder}/{r.file}"
            for r in small_file_candidates(listed, self.spec.small_file_bytes).select("folder", "file").collect()
        }
        packed = [f for f in version.files if f.path in chosen]
        if not packed:
            return None
        with _Work(self.spark, self._storage) as work:
            rows = self._rows(version, _singly(packed))
            return self._commit(version, rows, removed=packed, **work.identity("compact_files"))

    def expire(self, versions: int | None = None, commits: int | None = None) -> int:
        """Remove files that only older versions need; returns how many went."""
        if (versions is None) == (commits is None):
            raise ValueError("give either the number of versions or the number of commits to retain")
        if not self.exists():
            return 0
        lives = self.file_lives().where(F.col("expired").isNull())
        if versions is not None:
            listed = expirable_by_versions(lives, versions)
        else:
            states = self.history().where(F.col("operation") != "expire")
            listed = expirable_by_commits(lives, states, commits)
        gone = [
            DataFile(f"{r.folder}/{r.file}", r.folder, r.kind, r.part_key, r.rows, r.bytes, False)
            for r in listed.select("folder", "file", "kind", "part_key", "rows", "bytes").collect()
        ]
        if gone:
            staying = lives.join(listed.select("folder", "file"), ["folder", "file"], "left_anti")
            in_use = {r.folder for r in staying.select("folder").distinct().collect()}
            paths = {f.path if f.folder in in_use else f.folder for f in gone}
            # Published first: a reader is told that a version is gone before its files are.
            with _Work(self.spark, self._storage) as work:
                self._commit(self.version(), None, removed=gone, action="expire", **work.identity("expire"))
            self._storage.remove_all(f"{self.data_root}/{path}" for path in sorted(paths))
        return len(gone)

    def fold_manifests(self, at_least: int = FOLD_AFTER) -> int:
        """Fold the manifests of past commits into one set of files, once there are enough of them.

        Entries of expired files are left out; the versions that needed them
        are marked as no longer readable. Returns how many commits were folded.
        """
        names = [n for n in self._storage.children(self.manifest_root) if n.startswith("commit=")]
        if len(names) < at_least:
            return 0
        entries = self.manifest()
        expired = self.file_lives().where(F.col("expired").isNotNull())
        kept = entries.join(expired.select("folder", "file"), ["folder", "file"], "left_anti")
        horizon = (
            expired.agg(F.max("removed").alias("seq"))
            .where(F.col("seq").isNotNull())
            .withColumn("kind", F.lit("horizon"))
        )
        upto = max(_seq_of(name) for name in names)
        folded = kept.unionByName(horizon, allowMissingColumns=True).select(*MANIFEST_SCHEMA.names)
        _, before = self.folded()
        folded.write.parquet(f"{self.root}/_folded/upto={upto:010d}-{uuid.uuid4().hex[:8]}")
        self._storage.remove_all([f"{self.manifest_root}/{name}" for name in names] + ([before] if before else []))
        return len(names)

    # ---- the steps of a write -------------------------------------------

    def _apply(self, df: DataFrame, plan: Callable, batch: dict, evolve: bool = True) -> int | None:
        version = batch.pop("version", None) or self.version(**batch)
        if version.identity not in (None, self.identity):
            raise TableMismatch(f"{self.root} was created as {version.identity}, not {self.identity}")
        if version.has_batch or (version.schema is None and not evolve):
            return None  # applied before, or nothing there to remove from
        if version.schema is None:
            rows = self._guarded(conform_to(df, merged_schema(T.StructType([]), df.schema)))
        elif evolve:
            version.schema = merged_schema(version.schema, df.schema)
            rows = self._guarded(conform_to(df, version.schema))
        else:
            held = {name.lower() for name in df.columns}
            known = T.StructType([f for f in version.schema.fields if f.name.lower() in held])
            rows = conform_to(df, known)
        with _Work(self.spark, self._storage, batch) as work:
            return plan(version, rows, work)

    def _guarded(self, rows: DataFrame) -> DataFrame:
        """Fail on rows the table could not give back: a null key, or a partition value that reads as null."""
        named = dict.fromkeys((*self.key.scope, *self.key.ordering, *self.key.parts))
        lost = [name for name in named if name not in rows.columns]
        for name in set(self.key.parts) - set(lost):
            kind = rows.schema[name].dataType
            if not isinstance(kind, PARTITION_TYPES):
                raise ValueError(f"{name}: a table cannot be partitioned by {kind.simpleString()}; cast it to a date, a zone-less timestamp, a whole number or text")
        if lost:
            raise ValueError(f"the batch lacks the columns {lost} (has {rows.columns})")
        checks = {}
        for name in self.key.keys:
            checks[name] = F.coalesce(F.col(name), F.raise_error(F.lit(f"null key: {name}")).cast(rows.schema[name].dataType))
        for name in self.key.parts:
            if isinstance(rows.schema[name].dataType, T.StringType):
                value = checks.get(name, F.col(name))
                refuse = F.raise_error(F.lit(f"empty partition value: {name}")).cast("string")
                checks[name] = F.when(value == "", refuse).otherwise(value)
        return rows.withColumns(checks)

    def _without_log(self, version: Version) -> Version:
        """Changes that are not keyed by upsert need their effect ordered after the log."""
        if not version.of("log"):
            return version
        self.compact_log()
        compacted = self.version()
        compacted.schema = version.schema
        return compacted

    def _merge(
        self,
        version: Version,
        batch: Batch,
        work: "_Work",
        operation: str,
        store: bool = True,
        also_removed: Sequence[DataFile] = (),
    ) -> int:
        """Rewrite the files holding rows that the batch (one row per key) replaces."""
        candidates = self._candidates(version, batch)
        replacing, files = batch.data, []
        if candidates and batch.rows:
            found = self._lookup(version, candidates, batch)
            if store and self.key.event_time and self.key.ordering:
                side = self._key_side(batch.data, batch, with_ordering=True)
                hits = found.join(side, self.key.same_scope(_IN), "inner").select(
                    *self.key.scope, _FILE, beats_incoming(self.key).alias("__beats")
                )
                hits, _ = work.stage(hits)
                beaten = keyed_side(hits.where("__beats").select(*self.key.scope).distinct(), self.key)
                replacing = surviving(batch.data, beaten, self.key)
                # A file is touched if it has a row that does not beat its incoming row.
                touched = hits.where(~F.col("__beats"))
            else:
                touched = found.join(self._key_side(batch.data, batch), self.key.same_scope(_IN), "left_semi")
            files = self._numbered(touched.select(_FILE).distinct(), version, candidates)
        # One scan of the touched files, past a side that has one row per key.
        kept = None
        if files:
            kept = surviving(self._rows(version, _singly(files)), self._key_side(replacing, batch), self.key)
        stored = replacing if store else None
        return self._commit(version, stored, kept=kept, removed=[*files, *also_removed], **work.identity(operation))

    def _candidates(self, version: Version, batch: Batch) -> list[DataFile]:
        """Base files that may hold a key of the batch."""
        base = version.of("base")
        return base if self.key.global_keys else [f for f in base if f.part_key in batch.part_keys]

    def _staged(self, work: "_Work", rows: DataFrame) -> Batch:
        lead = self.key.keys[0]
        narrow = [f for f in rows.schema.fields if f.name in self.key.scope or f.name in self.key.ordering]
        # Keys to delete table-wide come without their partition.
        part_key = self._part_key() if set(self.key.parts) <= set(rows.columns) else F.lit(None).cast("string")
        data, seen = work.stage(
            rows,
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(_row_bytes(narrow)), F.lit(0)).alias("bytes"),
            F.min(lead).alias("low"),
            F.max(lead).alias("high"),
            F.collect_set(part_key).alias("part_keys"),
        )
        return Batch(data, **{**seen, "part_keys": frozenset(seen["part_keys"])})

    def _lookup(self, version: Version, files: Sequence[DataFile], batch: Batch) -> DataFrame:
        """Key and ordering columns of the files' rows with their file, pruned to the batch's keys."""
        lead = self.key.keys[0]
        scan = self._scan(version, _singly(files))
        if isinstance(version.schema[lead].dataType, PRUNABLE) and batch.low is not None:
            if batch.rows <= LISTED_KEYS:
                listed = {row[0] for row in batch.data.select(lead).collect()}
                scan = scan.where(F.col(lead).isin(list(listed)))
            else:
                scan = scan.where(F.col(lead).between(F.lit(batch.low), F.lit(batch.high)))
        narrow = dict.fromkeys((*self.key.scope, *self.key.ordering))
        # A number for the file: paths are longer than the keys, and would be shuffled with them.
        return scan.select(*[F.col(name) for name in narrow], _file_number(F.col("_metadata.file_path")).alias(_FILE))

    def _key_side(self, rows: DataFrame, batch: Batch, with_ordering: bool = False) -> DataFrame:
        """The batch's keys as a right side, broadcast only if they measured small enough."""
        side = keyed_side(rows, self.key, with_ordering)
        return F.broadcast(side) if batch.bytes <= BROADCAST_BYTES else side

    def _ranges(self, staged: DataFrame) -> int | None:
        """Number of ranges that keeps files, and what a task sorts, below their limits, if the session's default would not."""
        stored_bytes = int(staged._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        wanted = -(-stored_bytes // self._write_bytes)
        return wanted if wanted > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else None

    def _part_key(self) -> Column:
        """A row's partition as text: exact, and the same in every session."""
        if not self.key.parts:
            return F.lit("{}")
        return F.to_json(F.struct(*[F.col(n).cast("string").alias(n) for n in self.key.parts]), {"ignoreNullFields": "false"})

    def _numbered(self, hits: DataFrame, version: Version, candidates: Sequence[DataFile]) -> list[DataFile]:
        """The candidates among the files with these numbers."""
        below = [p.rsplit(_MARKER, 1)[1] for p in self._scan(version, _singly(candidates)).inputFiles()]
        live = self.spark.createDataFrame(pa.table({"below": pa.array(below, pa.string())})).withColumn("__number", F.xxhash64("below"))
        hit = [r.below for r in hits.join(live, F.col(_FILE) == F.col("__number"), "left").select("below").collect()]
        found = {unquote(path) for path in hit if path is not None}
        files = [f for f in candidates if f.path[len(COMMIT_COLUMN) + 1 :] in found]
        if len(files) != len(hit):
            raise RuntimeError(f"{self.root}: {len(hit)} files were hit, {len(files)} of them are known")
        return files

    def _commit(
        self,
        version: Version,
        rows: DataFrame | None,
        kept: DataFrame | None = None,
        removed: Sequence[DataFile] = (),
        kind: str = "base",
        action: str = "remove",
        cluster: bool = True,
        operation: str = "",
        stream_id: str | None = None,
        batch_id: int | None = None,
    ) -> int:
        """Write new rows (and kept rows of rewritten files), then publish the manifest."""
        if kind == "base" and cluster and operation in PACKING:
            crowd = self._crowd(version, removed)
            if crowd:
                more = self._rows(version, _singly(crowd))
                kept, removed = more if kept is None else kept.unionByName(more), [*removed, *crowd]
        schema = version.schema
        if schema is None and rows is not None:
            schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields])
        seq, attempt = version.seq + 1, uuid.uuid4().hex[:8]
        folder = f"{self.data_root}/{COMMIT_COLUMN}={seq:010d}-{attempt}"
        if rows is not None or kept is not None:
            self._write_files(rows, kept, folder, version, cluster)

        header = {
            "seq": seq,
            "kind": "commit",
            "operation": operation,
            "stream_id": stream_id,
            "batch_id": batch_id,
            "committed_at": dt.datetime.now(dt.timezone.utc).isoformat(),
            "table_schema": schema.json() if schema is not None else None,
            "identity": self.identity,
        }
        leaving = [
            {
                "seq": seq,
                "kind": f.kind,
                "action": action,
                "part_key": f.part_key,
                "folder": f.folder,
                "file": f.path[len(f.folder) + 1 :],
                "rows": f.rows,
                "bytes": f.bytes,
            }
            for f in removed
        ]
        manifest = self.spark.createDataFrame(pa.Table.from_pylist([header, *leaving], to_arrow_schema(MANIFEST_SCHEMA)))
        if rows is not None or kept is not None:
            manifest = manifest.unionByName(self._added(folder, schema, seq, kind), allowMissingColumns=True)
        with self._claim(seq):
            # A manifest is file addresses only; one output file makes its appearance atomic.
            manifest.coalesce(1).write.json(f"{self.manifest_root}/commit={seq:010d}-{attempt}")
        return seq

    @contextmanager
    def _claim(self, seq: int) -> Iterator[None]:
        """Hold a commit number while its manifest is written; the second of two writers fails and the table stays sound."""
        claim = f"{self.root}/_claims/{seq:010d}"
        if not self._storage.create_new(claim):
            if time.time() - self._storage.modified(claim) < CLAIM_SECONDS:
                raise ConcurrentWrite(f"{self.root}: another writer is publishing commit {seq}")
            # Left by a writer that died; whether it had published shows below.
        try:
            published = any(_seq_of(n) >= seq for n in self._storage.children(self.manifest_root) if n.startswith("commit="))
            if published or self.folded()[0] >= seq:
                raise ConcurrentWrite(f"{self.root}: commit {seq} was published by another writer")
            yield
        finally:
            self._storage.remove(claim)

    def remove_orphans(self, hours: float = 24) -> int:
        """Remove data folders that no manifest names, left by failed writes, once they are old enough not to be in progress."""
        begun = [n for n in self._storage.children(self.data_root) if n.startswith(f"{COMMIT_COLUMN}=")]
        if not begun:
            return 0
        named = self.manifest().where("folder IS NOT NULL").select(F.substring_index("folder", "/", 1).alias("top")).distinct()
        known = {r.top for r in named.collect()}
        paths = [f"{self.data_root}/{n}" for n in begun if n not in known]
        return self._storage.remove_all(p for p in paths if time.time() - self._storage.modified(p) >= hours * 3600)

    def _crowd(self, version: Version, leaving: Sequence[DataFile]) -> list[DataFile]:
        """The small files of partitions that would keep many of them; a write packs them with its own rows."""
        gone = {f.path for f in leaving}
        limit = min(self.spec.small_file_bytes, self.spec.max_file_bytes // 4, PACKED_BYTES)
        small: dict[str | None, list[DataFile]] = {}
        for f in version.of("base"):
            if f.path not in gone and f.bytes < limit:
                small.setdefault(f.part_key, []).append(f)
        return [f for own in small.values() if len(own) >= SMALL_FILES_KEPT for f in own]

    def _write_files(
        self, rows: DataFrame | None, kept: DataFrame | None, folder: str, version: Version, cluster: bool
    ) -> None:
        parts = self.key.parts
        out = rows if kept is None else kept if rows is None else rows.unionByName(kept)
        if cluster:
            # Splits large partitions over tasks and gathers small ones: kept rows too, which come
            # out of a join dealt by key or not, so that the files do not depend on the join.
            out = out.hint("rebalance", *parts) if parts else out.hint("rebalance")
        # The writer needs its tasks sorted by partition anyway; sorted by key
        # too, a file's row groups cover narrow key ranges that lookups can skip.
        if cluster or not self.spec.cluster_by:
            out = out.sortWithinPartitions(*parts, *(k for k in self.key.keys if k not in parts))
        writer = out.write.option("compression", self.spec.codec)
        held_rows = sum(f.rows for f in version.files)
        held_bytes = sum(f.bytes for f in version.files)
        if held_rows and held_bytes:
            writer = writer.option("maxRecordsPerFile", max(1, self.spec.max_file_bytes * held_rows // held_bytes))
        if self.spec.key_bloom:
            writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
            for name in self.key.keys:
                if name not in parts:
                    writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
        if parts:
            writer = writer.partitionBy(*parts)
        with setting(out.sparkSession, "spark.sql.adaptive.advisoryPartitionSizeInBytes", str(self._write_bytes)):
            writer.parquet(folder)

    def _added(self, folder: str, schema: T.StructType, seq: int, kind: str) -> DataFrame:
        """Manifest rows of the files in a freshly written folder, counted from their footers."""
        commit_folder = folder[len(self.data_root) + 1 :]
        plain = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
        below = F.element_at(F.split(plain, f"/data/{COMMIT_COLUMN}="), -1)
        name = F.element_at(F.split(below, "/"), -1)
        return (
            self.spark.read.schema(schema)
            .parquet(folder)
            .groupBy(
                F.col("_metadata.file_path").alias("path"),
                F.col("_metadata.file_size").alias("bytes"),
                *self.key.parts,
            )
            .agg(F.count("*").alias("rows"))
            .withColumn("part_key", self._part_key())
            .select(
                F.lit(seq).cast("long").alias("seq"),
                F.lit(kind).alias("kind"),
                F.lit("add").alias("action"),
                "part_key",
                F.concat(
                    F.lit(f"{COMMIT_COLUMN}="), below.substr(F.lit(1), F.length(below) - F.length(name) - 1)
                ).alias("folder"),
                name.alias("file"),
                "rows",
                "bytes",
            )
        )


class _Work:
    """Staged data and the identity of one write."""

    def __init__(self, spark: SparkSession, storage: Storage, batch: dict | None = None):
        self._spark = spark
        self._storage = storage
        self._batch = batch or {}
        self._staged: list[str] = []

    def __enter__(self) -> "_Work":
        return self

    def __exit__(self, *_) -> None:
        self._storage.remove_all(self._staged)

    def identity(self, operation: str) -> dict:
        return {"operation": operation, **self._batch}

    def stage(self, df: DataFrame, *metrics: Column) -> tuple[DataFrame, dict]:
        """Write ``df`` to shared storage and read it back: later steps need not recompute it.

        The metrics are taken while it is written, in the stage that writes.
        """
        path = fresh_path(self._spark, "stage")
        seen = Observation()
        (df.observe(seen, *metrics) if metrics else df).write.parquet(path)
        self._staged.append(path)
        return self._spark.read.schema(df.schema).parquet(path), seen.get if metrics else {}


def _file_number(path: Column) -> Column:
    """A number for a data file, from its address below the table's root: the schemes of paths are spelt in several ways."""
    return F.xxhash64(F.substring_index(path, _MARKER, -1))


def _lives(entries: DataFrame, *more) -> DataFrame:
    at = lambda action: F.max(F.when(F.col("action") == action, F.col("seq")))
    return entries.groupBy("folder", "file", "kind").agg(
        F.max("part_key").alias("part_key"),
        F.max("rows").alias("rows"),
        F.max("bytes").alias("bytes"),
        at("add").alias("added"),
        at("remove").alias("removed"),
        at("expire").alias("expired"),
        *more,
    )


def _singly(files: Sequence[DataFile]) -> list[DataFile]:
    """A chosen subset of a version's files must not be widened to whole folders."""
    return [DataFile(f.path, f.folder, f.kind, f.part_key, f.rows, f.bytes, False) for f in files]


def _seq_of(folder: str) -> int:
    return int(folder.split("=", 1)[1].split("-", 1)[0])


def _row_bytes(fields: Sequence[T.StructField]):
    """An upper estimate of the memory a row's columns take: a fixed part and its text lengths."""
    size = F.lit(32 + 16 * len(fields)).cast("long")
    for f in fields:
        if not isinstance(f.dataType, FIXED_WIDTH):
            size = size + F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0))
    return size
