"""How the rows of a table are identified and which of two versions of a row is newer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.ordering import ordering_columns


@dataclass(frozen=True)
class KeySpec:
    """Record key, ordering and partitioning of a keyed table.

    ``global_keys``  a key is unique in the whole table (else per partition).
    ``event_time``   the greater ordering tuple wins an upsert, a full tie going
                     to the incoming row (else the incoming row always wins).
    """

    keys: tuple[str, ...]
    ordering: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()
    global_keys: bool = False
    event_time: bool = False
    ordering_as_timestamp: bool = False

    @property
    def scope(self) -> tuple[str, ...]:
        """The columns within which a row is unique."""
        if self.global_keys:
            return self.keys
        return (*(p for p in self.parts if p not in self.keys), *self.keys)

    def ordering_values(self) -> list[Column]:
        return ordering_columns(self.ordering, self.ordering_as_timestamp)

    def same_scope(self, right_prefix: str) -> Column:
        """Join condition against a right side whose scope columns carry a prefix.

        A partition value may be null and still is one partition; a null key
        equals nothing.
        """
        condition = F.lit(True)
        for name in self.scope:
            left, right = F.col(name), F.col(right_prefix + name)
            condition &= (left == right) if name in self.keys else left.eqNullSafe(right)
        return condition

    def scope_as(self, prefix: str) -> list[Column]:
        return [F.col(name).alias(prefix + name) for name in self.scope]
