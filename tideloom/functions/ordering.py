"""Comparing records by their ordering columns, nulls counting as earliest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordering_columns(names: Sequence[str], as_timestamp: bool = False) -> list[Column]:
    """The comparable values of the ordering columns.

    With ``as_timestamp`` an ISO text is compared as a point in time, and as
    text only among equal points (or where it cannot be parsed).
    """
    if not as_timestamp:
        return [F.col(name) for name in names]
    out = []
    for name in names:
        out += [F.try_to_timestamp(F.col(name).cast("string")), F.col(name)]
    return out


def order_latest_first(columns: Sequence[Column]) -> list[Column]:
    return [column.desc_nulls_last() for column in columns]


def is_later(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Whether the left ordering tuple is strictly greater than the right one.

    Struct comparison is lexicographic with null as the smallest value and
    never yields null itself, which is the rule wanted here.
    """
    if not left:
        return F.lit(False)
    pack = lambda cols: F.struct(*[c.alias(f"o{i}") for i, c in enumerate(cols)])
    return pack(left) > pack(right)
