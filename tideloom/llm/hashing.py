"""Approximate nearest neighbours by multi-index hashing.

A rotation learned from a bounded sample turns unit vectors into binary codes. Codes are cut
into substrings, each with an index of its own. Two codes within a Hamming radius agree in
some substring up to that substring's share of the radius, so that probing every index
within its share retrieves every code within the radius; those are ranked by the cosine of
the vectors themselves.
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

BITS, SUBSTRINGS, PREFIX_BITS = 64, 4, 3
#: Vectors that the rotation and the radius are learned from; sampled queries; share of true neighbours the radius is to hold.
SAMPLE_ROWS, SAMPLE_QUERIES, HELD, ROUNDS = 4096, 512, 0.98, 30
SEED = 11


def units(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1)[:, None]


class Codes:
    """Codes of unit vectors: rotated principal components, one bit each, learned by iterative quantisation."""

    def __init__(self, sample: np.ndarray, bits: int = BITS):
        width = sample.shape[1]
        self.bits = max(1, min(bits, width))
        self.mean = sample.mean(axis=0) if len(sample) else np.zeros(width)
        centred = sample - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred) if width else (None, np.zeros((0, 0)))
        axes = axes[:, ::-1][:, : self.bits]
        rotation = np.linalg.qr(np.random.default_rng(SEED).normal(size=(axes.shape[1], axes.shape[1])))[0]
        reduced = centred @ axes
        for _ in range(ROUNDS if len(sample) else 0):
            left, _, right = np.linalg.svd(np.where(reduced @ rotation > 0, 1.0, -1.0).T @ reduced)
            rotation = (left @ right).T
        self.rotation = axes @ rotation
        step = -(-self.bits // SUBSTRINGS)
        self.cuts = [(at, min(at + step, self.bits)) for at in range(0, self.bits, step)]

    def of(self, u: np.ndarray) -> np.ndarray:
        signs = (u - self.mean) @ self.rotation > 0
        padded = np.zeros((len(u), 64), bool)
        padded[:, : signs.shape[1]] = signs
        return np.packbits(padded, axis=1, bitorder="little").view("<u8")[:, 0]

    def part(self, codes: np.ndarray, at: int) -> np.ndarray:
        low, high = self.cuts[at]
        return (codes >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)

    def prefix(self, parts: np.ndarray, at: int) -> np.ndarray:
        low, high = self.cuts[at]
        return (parts >> np.uint64(max(0, high - low - PREFIX_BITS))).astype(int)

    def shares(self, radius: int) -> list[int]:
        """The radius of each substring: if all were exceeded, the whole radius would be."""
        each, more = divmod(radius, len(self.cuts))
        return [each if i <= more else each - 1 for i in range(len(self.cuts))]


def learned_radius(codes: Codes, sample: np.ndarray, k: int, total: int) -> int:
    """The radius that holds nearly all true neighbours of sampled queries in the sample.

    A sample's neighbours are farther than the table's, so that the radius is on the safe side.
    """
    if len(sample) < 2:
        return codes.bits
    queries = sample[:SAMPLE_QUERIES]
    cosines = queries @ sample.T
    cosines[np.arange(len(queries)), np.arange(len(queries))] = -2
    rank = min(len(sample) - 1, max(1, -(-k * len(sample) // max(total, 1))))
    nearest = np.argsort(-cosines, axis=1)[:, :rank]
    own = codes.of(sample)
    return int(np.quantile(np.bitwise_count(own[nearest] ^ own[: len(queries), None]), HELD, method="higher"))


def search(df: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every``, the ``k`` nearest found by cosine.

    All rows are indexed and all but the query's own are candidates; a query that finds fewer
    than ``k`` within the radius is asked again without one, so that ``k`` (or all) come back.
    Ties go to the smaller id. Rows without an id, and vectors null, zero, or with null or
    non-finite components, take no part; shorter vectors count as padded with zeros. Repeated
    rows are rows of their own. An empty table gives an empty result.
    """
    rows = clean(df, vec_id, embedding)
    rows = staged(rows.where(F.exists("v", lambda x: x != 0)), "nonzero")
    size = rows.agg(F.max(F.size("v")).alias("width"), F.count("*").alias("n")).first()
    width, total = size.width or 0, size.n
    sample = units(sampled(rows, SAMPLE_ROWS, width))
    codes = Codes(sample)
    radius = learned_radius(codes, sample, k, total)
    prefixes = 1 << PREFIX_BITS

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = codes.of(units(matrix(batch.column(1), width)))
            for at in range(len(codes.cuts)):
                slot = at * prefixes + codes.prefix(codes.part(own, at), at)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.view("<i8")), pa.array(slot, pa.int32())], ["vec_id", "v", "row", "code", "slot"])

    entries = staged(map_batches(rows.select("vec_id", "v", "row"), index, "vec_id long, v array<double>, row long, code long, slot int"), "substrings")
    counts = {r.slot: r["count"] for r in entries.groupBy("slot").count().collect()}  # SUBSTRINGS x 2**PREFIX_BITS rows at most
    cells = Cells(counts, CELL_ROWS)
    members = cells.spread(entries, "slot")
    slots = np.array(cells.slots, int)

    def visits(within: int):
        shares = np.array(codes.shares(within))

        def to(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = codes.of(units(matrix(batch.column(1), width)))
                prefix = np.stack([codes.prefix(codes.part(own, at), at) for at in range(len(codes.cuts))], axis=1)
                differing = np.bitwise_count(prefix[:, slots // prefixes] ^ (slots % prefixes))
                query, hit = np.nonzero(differing <= shares[slots // prefixes])
                taken = pa.array(query)
                yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in batch.columns), pa.array(own.view("<i8")).take(taken), pa.array(slots[hit], pa.int32())], ["query_id", "q", "query_row", "code", "slot"])

        return to

    def look(within: int):
        shares = codes.shares(within)

        def probe(key, asking: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple] = []
            if len(asking) and len(here):
                at = cells.slot(int(key[0])) // prefixes
                own = here["code"].to_numpy(np.int64).view("<u8")
                parts = codes.part(own, at)
                order = np.argsort(parts, kind="stable")
                own, parts = own[order], parts[order]
                points, ids, row = stacked(here["v"], width)[order], here["vec_id"].to_numpy()[order], here["row"].to_numpy()[order]
                lengths = np.linalg.norm(points, axis=1)
                buckets, bucket_of = np.unique(parts, return_inverse=True)
                for query_id, q, query_row, code in zip(asking["query_id"], asking["q"], asking["query_row"], asking["code"].to_numpy(np.int64).view("<u8"), strict=True):
                    hit = np.bitwise_count(buckets ^ codes.part(code, at)) <= shares[at]
                    near = np.flatnonzero(hit[bucket_of])
                    near = near[np.bitwise_count(own[near] ^ code) <= within]
                    for earlier in range(at):  # found through the first substring that holds it, not again
                        near = near[np.bitwise_count(codes.part(own[near], earlier) ^ codes.part(code, earlier)) > shares[earlier]]
                    near = near[row[near] != query_row]
                    if len(near):
                        asked = stacked([q], width)[0]
                        scores = (points[near] * asked).sum(axis=1) / (lengths[near] * np.linalg.norm(asked))
                        for x in top(scores, ids[near], k):
                            out.append((query_id, query_row, row[near[x]], ids[near[x]], scores[x]))
            return pd.DataFrame(out, columns=["query_id", "query_row", "row", "vec_id", "score"])

        return probe

    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("row").alias("query_row"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    to_visit = "query_id long, q array<double>, query_row long, code long, slot int"
    visited = lambda asking, within: cells.of_visits(map_batches(asking, visits(within), to_visit), "slot")
    schema = "query_id long, query_row long, row long, vec_id long, score double"
    found = staged(best(in_cells(visited(queries, radius), members, blocks, look(radius), schema), k), "near")
    enough = found.groupBy("query_row").count().where(F.col("count") >= min(k, total - 1)).select("query_row")
    short = staged(queries.join(enough, "query_row", "left_anti").select("query_id", "q", "query_row"), "short")
    again = best(in_cells(visited(short, codes.bits), members, blocks, look(codes.bits), schema), k)
    whole = found.join(enough, "query_row", "left_semi").unionByName(again)
    return whole.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
