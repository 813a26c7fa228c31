from .clustering import z_order
from .keyspec import KeySpec
from .merge import (
    bulk_insert,
    delete_keys,
    drop_partitions,
    insert,
    insert_if_absent,
    merge_upsert,
    overwrite_partitions,
    surviving,
    winners,
)
from .notifications import expand_messages, filter_events
from .precombine import precombine
from .retention import expirable_by_commits, expirable_by_versions, small_file_candidates
from .temporal import in_force, within
from .transform import mark_invalid, preview, split_valid, sql_transform

__all__ = [
    "KeySpec",
    "bulk_insert",
    "delete_keys",
    "drop_partitions",
    "expand_messages",
    "expirable_by_commits",
    "expirable_by_versions",
    "filter_events",
    "in_force",
    "insert",
    "insert_if_absent",
    "mark_invalid",
    "merge_upsert",
    "overwrite_partitions",
    "precombine",
    "preview",
    "small_file_candidates",
    "split_valid",
    "sql_transform",
    "surviving",
    "winners",
    "within",
    "z_order",
]
