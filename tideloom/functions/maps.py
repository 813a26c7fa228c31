"""String-to-string maps used as run arguments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed prefix of every run argument name.
ARGUMENT_PREFIX = "--"

_EMPTY = "map<string,string>"


def _or_empty(arguments: Column) -> Column:
    return F.coalesce(arguments, F.create_map().cast(_EMPTY))


def prefix_keys(arguments: Column, prefix: str = ARGUMENT_PREFIX) -> Column:
    return F.transform_keys(arguments, lambda key, _: F.concat(F.lit(prefix), key))


def merge_maps(first: Column, second: Column) -> Column:
    """Union of two maps; the second wins on a shared key and a null map counts as empty."""
    left, right = _or_empty(first), _or_empty(second)
    only_left = F.map_filter(left, lambda key, _: ~F.array_contains(F.map_keys(right), key))
    return F.map_concat(only_left, right)


def present_options(arguments: Column, names: Sequence[str]) -> Column:
    """Keep the entries whose name is one of ``names``."""
    wanted = F.array(*[F.lit(name) for name in names])
    return F.map_filter(arguments, lambda key, _: F.array_contains(wanted, key))


def option_or(arguments: Column, name: str, default: str | None) -> Column:
    """The value stored under ``name``, or ``default`` where it is absent."""
    return F.coalesce(F.try_element_at(arguments, F.lit(name)), F.lit(default).cast("string"))
