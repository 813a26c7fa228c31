"""Run arguments of an ingestion job."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from ..functions.columns import ON_SPELLINGS
from ..functions.maps import ARGUMENT_PREFIX
from ..operators.keyspec import KeySpec
from ..sinks.table import COPY_ON_WRITE, LOG_COMMITS, MAX_FILE_BYTES, OPERATIONS, SMALL_FILE_BYTES, TableSpec

# Argument names as jobs pass them (one of them misspelt) and their
# defaults; None marks an argument without a default.
DEFAULTS: dict[str, str | None] = {
    "QUEUE_URL": "",
    "JOB_NAME": None,
    "GLUE_DATABASE": "",
    "GLUE_TABLE_NAME": "",
    "HUDI_TABLE_TYPE": "COPY_ON_WRITE",
    "HUDI_PRECOMB_KEY": "",
    "HUDI_RECORD_KEY": "",
    "ENABLE_CLEANER": "False",
    "ENABLE_HIVE_SYNC": "True",
    "ENABLE_PARTITION": "False",
    "INDEX_TYPE": "BLOOM",
    "PARTITON_FIELDS": None,
    "USE_SQL_TRANSFORMER": "False",
    "SQL_TRANSFORMER_QUERY": "default",
    "TARGET_S3_PATH": "",
    "HUDI_METHOD": "upsert",
}

# Our names for the same arguments.
ALIASES: dict[str, str] = {
    "queue_url": "QUEUE_URL",
    "job_name": "JOB_NAME",
    "database": "GLUE_DATABASE",
    "table_name": "GLUE_TABLE_NAME",
    "table_type": "HUDI_TABLE_TYPE",
    "ordering": "HUDI_PRECOMB_KEY",
    "record_key": "HUDI_RECORD_KEY",
    "enable_cleaner": "ENABLE_CLEANER",
    "enable_catalog": "ENABLE_HIVE_SYNC",
    "enable_partition": "ENABLE_PARTITION",
    "index_type": "INDEX_TYPE",
    "partition_fields": "PARTITON_FIELDS",
    "use_sql_transformer": "USE_SQL_TRANSFORMER",
    "sql_transformer_query": "SQL_TRANSFORMER_QUERY",
    "target_path": "TARGET_S3_PATH",
    "operation": "HUDI_METHOD",
}

# Key scopes, merge modes and retention.
LOCAL_INDEX = "BLOOM"
GLOBAL_INDEX = "GLOBAL_BLOOM"
COMMIT_TIME = "commit_time"
EVENT_TIME = "event_time"
RETAINED_VERSIONS = 3
RETAINED_COMMITS = 5


def _is_on(value: object) -> bool:
    return value is True or value in ON_SPELLINGS


def _names(text: str | None) -> tuple[str, ...]:
    return tuple(name.strip() for name in (text or "").split(",") if name.strip())


@dataclass(frozen=True)
class IngestConfig:
    target_path: str
    record_key: tuple[str, ...]
    ordering: tuple[str, ...] = ()
    partitions: tuple[str, ...] = ()
    job_name: str = ""
    database: str = ""
    table_name: str = ""
    table_type: str = COPY_ON_WRITE
    operation: str = "upsert"
    index_type: str = LOCAL_INDEX
    merge_mode: str = COMMIT_TIME
    ordering_as_timestamp: bool = False
    sql_query: str | None = None
    enable_cleaner: bool = False
    enable_catalog: bool = False
    clean_policy: str = "versions"
    retained: int | None = None
    codec: str = "gzip"
    max_file_bytes: int = MAX_FILE_BYTES
    small_file_bytes: int = SMALL_FILE_BYTES
    # Change-log commits of a merge-on-read table after which a run folds them into the base files.
    log_commits: int = LOG_COMMITS
    # Columns along whose curve a bulk insert lays out its rows.
    cluster_by: tuple[str, ...] = ()
    quarantine_path: str | None = None
    timestamps: tuple[str, ...] = ()
    # A format of an installed connector to append to, instead of the versioned table.
    sink: str | None = None
    sink_options: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not self.target_path:
            raise ValueError("no target path given")
        if not self.record_key:
            raise ValueError("no record key given")
        if self.operation not in OPERATIONS:
            raise ValueError(f"unknown operation {self.operation}; expected one of {OPERATIONS}")
        if self.index_type not in (LOCAL_INDEX, GLOBAL_INDEX):
            raise ValueError(f"unknown index type {self.index_type}")
        if self.merge_mode not in (COMMIT_TIME, EVENT_TIME):
            raise ValueError(f"unknown merge mode {self.merge_mode}")
        if self.clean_policy not in ("versions", "commits"):
            raise ValueError(f"unknown clean policy {self.clean_policy}")
        if self.sql_query is not None and self.sql_query.strip() in ("", "default"):
            raise ValueError("the SQL transformer is switched on without a query")

    @classmethod
    def from_arguments(cls, arguments: Mapping[str, object], **options) -> "IngestConfig":
        """From a run's arguments, with or without the ``--`` prefix and under either name.

        ``options`` are settings that run arguments have no name for.
        """
        given: dict[str, object] = {}
        for raw, value in arguments.items():
            name = raw.removeprefix(ARGUMENT_PREFIX)
            name = ALIASES.get(name, name)
            if name in DEFAULTS and value is not None:
                given[name] = value
        if not given.get("JOB_NAME"):
            raise ValueError("the argument JOB_NAME is required")
        held = {name: given.get(name, default) for name, default in DEFAULTS.items()}
        partitioned = _is_on(held["ENABLE_PARTITION"])
        parts = _names(held["PARTITON_FIELDS"])
        if partitioned and not parts:
            raise ValueError("partitioning is switched on without partition fields")
        return cls(
            target_path=held["TARGET_S3_PATH"],
            record_key=_names(held["HUDI_RECORD_KEY"]),
            ordering=_names(held["HUDI_PRECOMB_KEY"]),
            partitions=parts if partitioned else (),
            job_name=held["JOB_NAME"],
            database=held["GLUE_DATABASE"],
            table_name=held["GLUE_TABLE_NAME"],
            table_type=held["HUDI_TABLE_TYPE"],
            operation=held["HUDI_METHOD"],
            index_type=held["INDEX_TYPE"],
            sql_query=held["SQL_TRANSFORMER_QUERY"] if _is_on(held["USE_SQL_TRANSFORMER"]) else None,
            enable_cleaner=_is_on(held["ENABLE_CLEANER"]),
            enable_catalog=_is_on(held["ENABLE_HIVE_SYNC"]) and bool(held["GLUE_DATABASE"]),
            **options,
        )

    @property
    def key(self) -> KeySpec:
        return KeySpec(
            keys=self.record_key,
            ordering=self.ordering,
            parts=self.partitions,
            global_keys=self.index_type == GLOBAL_INDEX,
            event_time=self.merge_mode == EVENT_TIME,
            ordering_as_timestamp=self.ordering_as_timestamp,
        )

    @property
    def table(self) -> TableSpec:
        return TableSpec(
            key=self.key,
            table_type=self.table_type,
            codec=self.codec,
            max_file_bytes=self.max_file_bytes,
            small_file_bytes=self.small_file_bytes,
            cluster_by=self.cluster_by,
        )

    @property
    def retention(self) -> dict[str, int]:
        default = RETAINED_VERSIONS if self.clean_policy == "versions" else RETAINED_COMMITS
        return {self.clean_policy: self.retained or default}
