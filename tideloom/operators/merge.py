"""Keyed merges of a current table and an incoming batch.

None of them gathers the rows of a key. Most are a semi or anti join that
streams the current rows past at most one incoming row per key. An upsert deals
both sides anew for that join, so adaptive execution can split the shuffle
partition of a key that holds a large share of the table. Where only the latest
row of a key counts, each task keeps one row per key before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import conform_to, content_order, merged_schema
from ..functions.ordering import is_later
from .clustering import z_order
from .keyspec import KeySpec
from .precombine import precombine

_IN = "__in_"
_PLACE = "__place"
_ARRIVED = "__arrived"


def _aligned(current: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    schema = merged_schema(current.schema, incoming.schema)
    return conform_to(current, schema), conform_to(incoming, schema)


def keyed_side(rows: DataFrame, spec: KeySpec, with_ordering: bool = False) -> DataFrame:
    """The scope columns (and ordering values) of a batch, renamed for use as a right side."""
    columns = spec.scope_as(_IN)
    if with_ordering:
        columns += [c.alias(f"{_IN}ordering_{i}") for i, c in enumerate(spec.ordering_values())]
    return rows.select(*columns)


def beats_incoming(spec: KeySpec):
    """Whether the current row is strictly later than the incoming one beside it."""
    mine = spec.ordering_values()
    theirs = [F.col(f"{_IN}ordering_{i}") for i in range(len(mine))]
    return is_later(mine, theirs)


def _matched(spec: KeySpec, small: bool = False) -> Column:
    """``same_scope`` that does not take over the shuffle of a side's window, unless a side is broadcast anyway.

    Adaptive execution splits a large partition (or broadcasts the other side) only where
    both sides come straight out of a shuffle of their own. The scope as one value, equal
    where its columns are, is a key that no side is dealt by yet.
    """
    if small:
        return spec.same_scope(_IN)
    mine, theirs = (F.struct(*[F.col(prefix + name).alias(name) for name in spec.scope]) for prefix in ("", _IN))
    return spec.same_scope(_IN) & (mine == theirs)


def surviving(current: DataFrame, keys: DataFrame, spec: KeySpec) -> DataFrame:
    """Current rows whose key is not among ``keys`` (made by ``keyed_side``)."""
    return current.join(keys, spec.same_scope(_IN), "left_anti")


def _hinted(side: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(side) if small else side


def winners(current: DataFrame, incoming: DataFrame, spec: KeySpec, small_incoming: bool = False) -> DataFrame:
    """The incoming rows (one per key) that an upsert stores."""
    if not spec.event_time or not spec.ordering:
        return incoming
    narrow = [F.col(name) for name in dict.fromkeys((*spec.scope, *spec.ordering))]
    side = _hinted(keyed_side(incoming, spec, with_ordering=True), small_incoming)
    beaten = (
        current.select(*narrow)
        .join(side, _matched(spec, small_incoming) & beats_incoming(spec), "left_semi")
        .select(*spec.scope)
        .distinct()
    )
    return surviving(incoming, _hinted(keyed_side(beaten, spec), small_incoming), spec)


def merge_upsert(
    current: DataFrame,
    incoming: DataFrame,
    spec: KeySpec,
    *,
    unique_incoming: bool = False,
    unique_current: bool = False,
    small_incoming: bool = False,
) -> DataFrame:
    """Update the rows whose key exists, insert the others.

    A stored incoming row replaces every current row of its key; an incoming
    row that loses in event-time order changes nothing. Rows with other keys
    pass through unchanged.

    What the caller knows picks the plan, never the result: ``small_incoming``
    (its keys were measured to fit a broadcast) leaves the current rows where
    they are; ``unique_current`` (no key occurs twice) needs a single shuffle.
    """
    current, incoming = _aligned(current, incoming)
    if unique_current and not small_incoming:
        return _latest_of_both(current, incoming, spec)
    batch = incoming if unique_incoming else precombine(incoming, spec)
    stored = winners(current, batch, spec, small_incoming)
    replaced = _hinted(keyed_side(stored, spec), small_incoming)
    kept = current.join(replaced, _matched(spec, small_incoming), "left_anti")
    return kept.unionByName(stored)


def _latest_of_both(current: DataFrame, incoming: DataFrame, spec: KeySpec) -> DataFrame:
    """Upsert into rows that have each key once: the latest row of both sides, in one shuffle."""
    arrived = F.col(_ARRIVED).desc()
    both = current.withColumn(_ARRIVED, F.lit(False)).unionByName(incoming.withColumn(_ARRIVED, F.lit(True)))
    if spec.event_time and spec.ordering:
        content = content_order(current.schema, skip=(*spec.scope, *spec.ordering))
        return precombine(both, spec, tiebreak=[arrived, *content]).drop(_ARRIVED)
    return precombine(both, spec, leading=[arrived]).drop(_ARRIVED)


def insert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append the batch as it is: no key lookup and no removal of duplicates."""
    current, incoming = _aligned(current, incoming)
    return current.unionByName(incoming)


def bulk_insert(incoming: DataFrame, spec: KeySpec, partitions: int | None = None, cluster_by: Sequence[str] = ()) -> DataFrame:
    """Lay a batch out by partition and key for an append; given ``cluster_by``, along a curve through those columns instead of by key.

    The row hash closes the range key, so that the rows of one frequent key or
    partition spread over several ranges.
    """
    if cluster_by:
        placed = z_order(incoming, cluster_by, _PLACE)
        return _dealt(placed, [F.col(name) for name in (*spec.parts, _PLACE)], partitions).drop(_PLACE)
    sort_by = [F.col(name) for name in (*spec.parts, *(k for k in spec.keys if k not in spec.parts))]
    return _dealt(incoming, sort_by, partitions) if sort_by else incoming


def _dealt(incoming: DataFrame, sort_by: Sequence[Column], partitions: int | None) -> DataFrame:
    hashable = [
        F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
        for f in incoming.schema.fields
        if "variant" not in f.dataType.simpleString()
    ]
    by = [*sort_by, F.xxhash64(*hashable)]
    spread = incoming.repartitionByRange(partitions, *by) if partitions else incoming.repartitionByRange(*by)
    return spread.sortWithinPartitions(*sort_by)


def delete_keys(current: DataFrame, keys: DataFrame, spec: KeySpec) -> DataFrame:
    """Remove the rows whose key occurs in ``keys``."""
    return surviving(current, keyed_side(keys, spec).distinct(), spec)


def insert_if_absent(current: DataFrame, incoming: DataFrame, spec: KeySpec) -> DataFrame:
    """Get or put: an existing row stays, an absent key gets the incoming row."""
    current, incoming = _aligned(current, incoming)
    batch = precombine(incoming, spec)
    held = keyed_side(current, spec).distinct()
    return current.unionByName(surviving(batch, held, spec))


def overwrite_partitions(current: DataFrame, incoming: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Replace the partitions that occur in the batch, keep the others."""
    current, incoming = _aligned(current, incoming)
    return drop_partitions(current, incoming, parts).unionByName(incoming)


def drop_partitions(current: DataFrame, partitions: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Remove every row that belongs to one of the listed partitions."""
    by_partition = KeySpec(keys=(), parts=tuple(parts))
    listed = partitions.select(*by_partition.scope_as(_IN)).distinct()
    return current.join(listed, by_partition.same_scope(_IN), "left_anti")
