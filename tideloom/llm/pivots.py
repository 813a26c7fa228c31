"""Exact top-k by inner product through a pivot-distance index.

Vectors get one more component that makes all equally long, so that the largest inner product
is the smallest Euclidean distance. Every vector belongs to the annulus of its nearest pivot
that its distance to the pivot falls in. A query first searches the annuli nearest to it; its
k-th best there bounds the distance of anything better, and by the triangle inequality only
annuli within that bound of the query's own distance to their pivot are searched after that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, staged
from .vectors import CELL_ROWS, QUERY_BLOCK, Cells, best, clean, in_cells, matrix, sampled, stacked, top

#: Rows aimed at per pivot, pivots at most and annuli for each; the sample that pivots are chosen from; rows that a query searches first, for each wanted.
PIVOT_ROWS, PIVOTS, ANNULI, SAMPLE_ROWS, FIRST_ROWS = 2048, 64, 8, 4096, 100


def scaled_floor(v: np.ndarray, scale: float = 64.0) -> np.ndarray:
    return np.floor(scale * v)


def _far_apart(points: np.ndarray, count: int) -> np.ndarray:
    """Positions of points each farthest from those before it."""
    chosen = [0]
    nearest = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(count, len(points)) and nearest.max() > 0:
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return np.array(chosen)


def search(df: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every``, the ``k`` rows of highest inner product.

    Components become ``floor(scale * x)``; all rows but the query's own are candidates, fewer
    than ``k`` are all returned, ties go to the smaller id. Rows without an id, and vectors
    null or with null or non-finite components, take no part; shorter vectors count as padded
    with zeros. Repeated rows are rows of their own. Scores are exact below 2**53. An empty
    table gives an empty result.
    """
    rows = clean(df, vec_id, embedding)
    size = rows.agg(F.max(F.size("v")).alias("width"), F.count("*").alias("n")).first()
    width, total = size.width or 0, size.n

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = scaled_floor(matrix(batch.column(1), width), scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(v), pa.list_(pa.float64())), batch.column(2), pa.array((v * v).sum(axis=1))], ["vec_id", "v", "row", "square"])

    points = staged(map_batches(rows.select("vec_id", "v", "row"), whole, "vec_id long, v array<double>, row long, square double"), "points")
    longest = float(points.agg(F.max("square")).first()[0] or 0.0)
    slack = 1e-6 * (1 + np.sqrt(longest))
    lift = lambda v: np.concatenate([v, np.sqrt(np.maximum(longest - (v * v).sum(axis=1), 0))[:, None]], axis=1)
    sample = lift(sampled(points, SAMPLE_ROWS, width))
    pivots = sample[_far_apart(sample, max(1, min(PIVOTS, total // PIVOT_ROWS)))] if total else np.zeros((1, width + 1))

    def distances(lifted: np.ndarray, squares: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(squares[:, None] + longest - 2 * lifted @ pivots.T, 0))

    radii = distances(sample, np.full(len(sample), longest)).min(axis=1) if total else np.zeros(1)
    edges = np.unique(np.quantile(radii, np.linspace(0, 1, ANNULI + 1)[1:-1]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lifted = lift(matrix(batch.column(1), width))
            far = distances(lifted, np.full(len(lifted), longest))
            pivot = far.argmin(axis=1)
            r = far[np.arange(len(far)), pivot]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(pivot * ANNULI + np.searchsorted(edges, r, "right")), pa.array(r)], ["vec_id", "v", "row", "annulus", "r"]
            )

    placed = staged(map_batches(points.select("vec_id", "v", "row"), place, "vec_id long, v array<double>, row long, annulus long, r double"), "annuli")
    # At most PIVOTS x ANNULI rows; an annulus of many rows is several cells, so that a hot one is spread.
    rings = placed.groupBy("annulus").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).orderBy("annulus").collect()
    cells = Cells({r.annulus: r.n for r in rings}, CELL_ROWS)
    members = cells.spread(placed, "annulus")
    annuli = np.array([r.annulus for r in rings], int)
    low, high, held = (np.array([r[name] for r in rings], float) for name in ("low", "high", "n"))

    def visits(again: bool):
        def to(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = matrix(batch.column(1), width)
                squares = (v * v).sum(axis=1)
                far = distances(np.concatenate([v, np.zeros((len(v), 1))], axis=1), squares)[:, annuli // ANNULI]
                bound = np.maximum(np.maximum(low - far, far - high), 0)
                order = np.argsort(bound, axis=1, kind="stable")
                before = np.cumsum(held[order], axis=1) - held[order]
                early = np.zeros(bound.shape, bool)
                np.put_along_axis(early, order, before < FIRST_ROWS * k, axis=1)
                if again:
                    worst = batch.column(3).to_numpy(zero_copy_only=False)
                    reach = np.sqrt(np.maximum(squares + longest - 2 * worst, 0)) + slack
                    query, hit = np.nonzero(~early & ~(bound > reach[:, None]))
                else:
                    query, hit = np.nonzero(early)
                taken = pa.array(query)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(taken) for i in range(4)), pa.array(far[query, hit]), pa.array(annuli[hit])], ["query_id", "q", "query_row", "worst", "far", "annulus"]
                )

        return to

    def look(key, asking: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(asking) and len(here):
            here = here.sort_values(["r", "row"])
            points, r, ids, own = stacked(here["v"], width), here["r"].to_numpy(), here["vec_id"].to_numpy(), here["row"].to_numpy()
            asking = asking.sort_values(["far", "query_row"])
            for at in range(0, len(asking), 128):
                block = asking.iloc[at : at + 128]
                q, far, worst = stacked(block["q"], width), block["far"].to_numpy(), block["worst"].to_numpy()
                reach = np.sqrt(np.maximum((q * q).sum(axis=1) + longest - 2 * worst, 0)) + slack
                # Rows sorted by distance to the pivot: those outside the annulus of the bound are not looked at.
                a, b = np.searchsorted(r, (far - reach).min(), "left"), np.searchsorted(r, (far + reach).max(), "right")
                scores = q @ points[a:b].T
                for i, (query_id, query_row) in enumerate(zip(block["query_id"], block["query_row"], strict=True)):
                    fit = np.flatnonzero((scores[i] >= worst[i]) & (own[a:b] != query_row))
                    for x in fit[top(scores[i][fit], ids[a:b][fit], k)]:
                        out.append((query_id, query_row, own[a + x], ids[a + x], scores[i][x]))
        return pd.DataFrame(out, columns=["query_id", "query_row", "row", "vec_id", "score"])

    queries = points.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("row").alias("query_row"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    to_visit = "query_id long, q array<double>, query_row long, worst double, far double, annulus long"
    visited = lambda asking, again: cells.of_visits(map_batches(asking, visits(again), to_visit), "annulus")
    schema = "query_id long, query_row long, row long, vec_id long, score double"
    early = visited(queries.withColumn("worst", F.lit(float("-inf"))), False)
    near = staged(best(in_cells(early, members, blocks, look, schema), k), "near")
    kth = near.groupBy("query_row").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
    known = queries.join(kth, "query_row", "left").select("query_id", "q", "query_row", F.when(F.col("n") >= k, F.col("worst")).otherwise(F.lit(float("-inf"))).alias("worst"))
    later = in_cells(visited(known, True), members, blocks, look, schema)
    found = best(near.drop("rank").unionByName(later), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.expr("try_cast(score AS bigint)").alias("score"))
