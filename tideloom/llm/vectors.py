"""What both vector searches need: clean vectors, cells of bounded size, and the join of queries with cells."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _ship, staged

#: Rows of a cell and queries that meet in one task.
CELL_ROWS = 8192
QUERY_BLOCK = 8192


def clean(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``row, vec_id, v`` of the rows that take part: an id, a vector, and only finite components.

    Vectors shorter than the longest count as padded with zeros.
    """
    v = F.col(embedding).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return staged(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")


def stacked(vectors: Iterable, width: int) -> np.ndarray:
    rows = list(vectors)
    out = np.zeros((len(rows), width))
    for at, row in enumerate(rows):
        out[at, : len(row)] = row
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return stacked((np.asarray(x.values) for x in column), width)


def sampled(vectors: DataFrame, rows: int, width: int) -> np.ndarray:
    """At most ``rows`` vectors, drawn by a hash of their row."""
    return stacked((r.v for r in vectors.orderBy(F.xxhash64(F.lit(1), "row"), "row").limit(rows).select("v").collect()), width)


def in_cells(visits: DataFrame, members: DataFrame, blocks: int, search: Callable, schema: str) -> DataFrame:
    """``search(key, visits, members)`` for each cell and block of queries.

    Both sides have a column ``cell``; visits also have ``query_row``. Cells have bounded rows,
    and so have the queries of a block, however many queries visit a cell. Members go to
    those blocks alone that have a query which visits their cell.
    """
    _ship(visits.sparkSession)
    left = visits.withColumn("block", F.pmod(F.xxhash64("query_row"), F.lit(blocks)).cast("int"))
    visiting = left.groupBy("cell").agg(F.collect_set("block").alias("visiting"))  # a row for each cell, of ``blocks`` numbers at most
    right = members.join(visiting, "cell").withColumn("block", F.explode("visiting")).drop("visiting")
    return left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInPandas(search, schema)


class Cells:
    """Numbered slots of counted rows, each in as many cells of bounded size as its rows need.

    There are a bounded number of slots; cells grow with the rows and are worked out by
    expressions, so that what a task holds goes by slots.
    """

    def __init__(self, counts: dict[int, int], rows: int):
        self.slots = sorted(counts)
        self.parts = [-(-counts[s] // rows) for s in self.slots]
        self.first = np.cumsum([0, *self.parts])[:-1]

    def _of(self, slot: str, values: Iterable) -> Column:
        pairs = [F.lit(int(x)) for pair in zip(self.slots, values, strict=True) for x in pair]
        return F.create_map(*(pairs or [F.lit(0), F.lit(0)]))[F.col(slot)]

    def spread(self, members: DataFrame, slot: str) -> DataFrame:
        """The members with the ``cell`` of their slot that their row's hash names, without the slot."""
        return members.withColumn("cell", (self._of(slot, self.first) + F.pmod(F.xxhash64("row"), self._of(slot, self.parts))).cast("int")).drop(slot)

    def of_visits(self, visits: DataFrame, slot: str) -> DataFrame:
        """A row for every ``cell`` of a visited slot, without the slot."""
        first = self._of(slot, self.first)
        return visits.withColumn("cell", F.explode(F.sequence(first, first + self._of(slot, self.parts) - 1).cast("array<int>"))).drop(slot)

    def slot(self, cell: int) -> int:
        return self.slots[int(np.searchsorted(self.first, cell, "right")) - 1]


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of highest score for each ``query_row``, ties to the smaller ``vec_id``, with their rank."""
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id"), F.col("row"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]
