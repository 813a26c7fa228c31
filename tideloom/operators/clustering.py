"""Clustering over several columns: rows in the order of a space-filling curve.

Every column's values are dealt to bins of about equal rows, by quantiles of the batch; the
bits of the bin numbers, taken in turn, make the place on a Z-order curve. Files written in
that order cover a narrow range of each of the columns, so that a filter on any of them skips
most files, not only one on the leading sort column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a bin number: 256 bins a column; quantiles are off by a millionth of the rows at most.
BITS = 8
ACCURACY = 1_000_000
_NUMBERS = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _bounds(df: DataFrame, columns: Sequence[str], bits: int) -> dict[str, list]:
    """Upper bounds of all bins but the last, for each column: at most ``2**bits`` values a column reach the driver."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    row = df.agg(*[F.percentile_approx(F.col(f"`{c}`"), shares, ACCURACY).alias(str(i)) for i, c in enumerate(columns)]).first()
    return {c: sorted(set(row[i] or [])) for i, c in enumerate(columns)}


def bin_numbers(df: DataFrame, columns: Sequence[str], bits: int = BITS) -> list[Column]:
    """The bin of each column: how many distinct bounds are below the value; 0 for null.

    A value that fills several bins has one of them, so that equal values share a bin.
    Numbers, dates and times have bins by rank; texts by the first 6 bytes, as a number.
    """
    ranked = df.select([_ranked(df, c).alias(c) for c in columns])
    bounds = _bounds(ranked, columns, bits)
    out = []
    for c in columns:
        out.append(_below(_ranked(df, c), bounds[c], bits).cast("long"))
    return out


def _ranked(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    value = F.col(f"`{column}`")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    return F.conv(F.hex(F.rpad(F.substring(value.cast("string").cast("binary"), 1, 6), 6, b"\x00")), 16, 10).cast("double")


def _below(value: Column, bounds: Sequence[float], bits: int) -> Column:
    """How many of the sorted bounds are less than the value; a search by halves, of one comparison a bit."""
    held = F.lit([*bounds, *[float("inf")] * ((1 << bits) - 1 - len(bounds))])
    steps = F.lit([1 << bit for bit in reversed(range(bits))])
    # Infinity is less than NaN alone, which comes last among numbers.
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(held, at + step - 1) < value, step).otherwise(0))


def interleaved(numbers: Sequence[Column], bits: int = BITS) -> Column:
    """The bits of the numbers in turn, highest first, the first number's leading."""
    place = F.lit(0).cast("long")
    for bit in reversed(range(bits)):
        for number in numbers:
            place = F.shiftleft(place, 1).bitwiseOR(F.shiftright(number, bit).bitwiseAND(F.lit(1)))
    return place


def z_order(df: DataFrame, columns: Sequence[str], into: str = "z", bits: int = BITS) -> DataFrame:
    """``df`` with the place of each row on the curve through ``columns`` (at most 63 bits in all)."""
    if not columns or bits * len(columns) > 63:
        raise ValueError(f"{len(columns)} columns of {bits} bits do not make a place of 1 to 63 bits")
    return df.withColumn(into, interleaved(bin_numbers(df, columns, bits), bits))
