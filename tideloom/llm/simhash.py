"""SimHash near duplicates: fingerprints, exact links within a Hamming radius by vantage-point trees, components.

Distinct fingerprints are dealt to the leaves of a vantage-point tree that is built from a
bounded sample; each fingerprint then visits every leaf that its ball of the link radius
overlaps, by the triangle inequality. Inside a leaf, a tree over the leaf's own members
finds all pairs within the radius. The tree decides only where pairs are looked for; no pair
within the radius is missed whatever the sample.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import component_roots, fresh_name, map_batches, map_groups, staged

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
#: Fingerprints aimed at per leaf, bounds of the tree's sample and leaves: fuller leaves are searched in blocks.
LEAF_ROWS = 32768
MAX_LEAVES = 16384
SAMPLE_ROWS = 1 << 18
MEMBER_BLOCK, VISITOR_BLOCK = 1 << 17, 1 << 19
_DISTANCES = np.arange(65)


def fingerprint(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Majority of the bits of the shingles' hashes; 0 for a text without words."""
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        spans = [joined]
    else:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        spans = [joined[a:b] for a, b in zip(starts[: -words + 1 or None].tolist(), ends[words - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in spans], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The key columns and ``fp`` (the 64 bits as a long) of every row; a null text counts as empty."""
    source = docs.select(*keys, F.col(text).cast("string").cast("binary").alias("__text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or b"") for t in batch.columns[-1]], "<u8")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view("<i8"))], [*keys, "fp"])

    return map_batches(source, of, T.StructType([*(docs.schema[k] for k in keys), T.StructField("fp", T.LongType())]))


def _split(points: np.ndarray, random: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and the radius that halves the points best; None for points that are all alike."""
    best = None
    for vantage in points[random.integers(0, len(points), 4)]:
        inside = np.cumsum(np.bincount(np.bitwise_count(points ^ vantage), minlength=65))
        crossing = np.array([inside[min(64, r + RADIUS)] - (inside[r - RADIUS] if r >= RADIUS else 0) for r in _DISTANCES])
        cost = np.abs(2 * inside - len(points)) + crossing // 4 + np.where((inside == 0) | (inside == len(points)), 4 * len(points), 0)
        radius = int(np.argmin(cost))
        if 0 < inside[radius] < len(points) and (best is None or cost[radius] < best[0]):
            best = (cost[radius], vantage, radius)
    return best and best[1:]


class Router:
    """The upper levels of a vantage-point tree; ``levels`` halvings at most."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.vantage: list[int] = []
        self.radius: list[int] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.root = self._grow(sample, leaves, np.random.default_rng(SEED))

    def _grow(self, points: np.ndarray, leaves: int, random: np.random.Generator) -> int:
        split = _split(points, random) if leaves > 1 and len(points) > 1 else None
        if split is None:
            self.leaves += 1
            return -self.leaves
        vantage, radius = split
        node = len(self.vantage)
        self.vantage.append(int(vantage))
        self.radius.append(radius)
        self.children.append([0, 0])
        near = np.bitwise_count(points ^ vantage) <= radius
        share = min(leaves - 1, max(1, round(leaves * near.mean())))
        self.children[node] = [self._grow(points[near], share, random), self._grow(points[~near], leaves - share, random)]
        return node

    def visits(self, points: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaves that a ball of radius ``slack`` around each point overlaps."""
        rows, leaves = [], []
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if node < 0:
                rows.append(own)
                leaves.append(np.full(len(own), -node - 1))
                continue
            distance = np.bitwise_count(points[own] ^ np.uint64(self.vantage[node])).astype(int)
            todo.append((self.children[node][0], own[distance <= self.radius[node] + slack]))
            todo.append((self.children[node][1], own[distance > self.radius[node] - slack]))
        if not rows:
            return np.empty(0, int), np.empty(0, int)
        return np.concatenate(rows), np.concatenate(leaves)


class _Union:
    def __init__(self, size: int):
        self.parent = np.arange(size)

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        while len(left):
            a, b = self.parent[left], self.parent[right]
            apart = a != b
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            if not len(left):
                return
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                above = self.parent[self.parent]
                if np.array_equal(above, self.parent):
                    break
                self.parent = above


def link(points: np.ndarray, members: np.ndarray, visitors: np.ndarray, radius: int = RADIUS, brute: int = 256) -> np.ndarray:
    """Root position of each point after all pairs of a member and a visitor within the radius are linked.

    ``members`` and ``visitors`` are positions in ``points``. Works down a vantage-point tree
    over the members; where a split no longer separates, or few members are left, it compares
    all pairs in blocks.
    """
    union, random = _Union(len(points)), np.random.default_rng(SEED)
    todo = [(members, visitors)]
    while todo:
        own, guests = todo.pop()
        if not len(own) or not len(guests):
            continue
        split = _split(points[own], random) if len(own) > brute else None
        if split is not None:
            vantage, at = split
            d_own = np.bitwise_count(points[own] ^ vantage).astype(int)
            d_guests = np.bitwise_count(points[guests] ^ vantage).astype(int)
            inner, outer = d_guests <= at + radius, d_guests > at - radius
            if int(inner.sum()) + int(outer.sum()) < 1.9 * len(guests):
                todo += [(own[d_own <= at], guests[inner]), (own[d_own > at], guests[outer])]
                continue
        for i in range(0, len(own), 1024):
            block = own[i : i + 1024]
            for j in range(0, len(guests), 1024):
                others = guests[j : j + 1024]
                x, y = np.nonzero(np.bitwise_count(points[block][:, None] ^ points[others][None, :]) <= radius)
                union.add(block[x], others[y])
    return union.parent


def links(distinct: DataFrame, radius: int = RADIUS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Edges ``u, v`` between distinct fingerprints (column ``fp``) that connect all within the radius of each other.

    Within a leaf the links are reduced to one edge per fingerprint, to a common root, so that
    dense groups do not emit their pairs.
    """
    count = distinct.count()
    leaves = min(MAX_LEAVES, -(-count // leaf_rows))
    sample = [r.fp for r in distinct.orderBy(F.xxhash64("fp")).limit(min(SAMPLE_ROWS, 64 * leaves)).collect()] if leaves > 1 else []
    router = Router(np.array(sample, "<i8").view("<u8"), leaves)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().view("<u8")
            rows, home = router.visits(points, 0)
            homes = np.empty(len(points), int)
            homes[rows] = home
            rows, leaf = router.visits(points, radius)
            later = leaf >= homes[rows]
            rows, leaf = rows[later], leaf[later]
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(points[rows].view("<i8")), pa.array(leaf == homes[rows])], ["leaf", "fp", "member"])

    dealt = staged(map_batches(distinct.select("fp"), deal, "leaf int, fp long, member boolean"), "leaves")
    sizes = dealt.groupBy("leaf").agg(F.count_if("member").alias("own"), F.count("*").alias("guests"))
    sizes = sizes.select(
        "leaf",
        F.ceil(F.col("own") / MEMBER_BLOCK).cast("int").alias("own_blocks"),
        F.ceil(F.col("guests") / VISITOR_BLOCK).cast("int").alias("guest_blocks"),
    ).where("own_blocks > 1 OR guest_blocks > 1")
    # At most one row for each leaf of the tree, of which there are MAX_LEAVES at most.
    split = dealt.join(F.broadcast(sizes), "leaf", "left").fillna(1, ["own_blocks", "guest_blocks"])
    pick = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    as_member = split.where("member").select(
        "leaf", "fp", F.lit(True).alias("member"), pick(F.col("own_blocks")).alias("i"), F.explode(every(F.col("guest_blocks"))).alias("j")
    )
    as_guest = split.select(
        "leaf", "fp", F.lit(False).alias("member"), F.explode(every(F.col("own_blocks"))).alias("i"), pick(F.col("guest_blocks")).alias("j")
    )

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        points, place = np.unique(rows["fp"].to_numpy(np.int64), return_inverse=True)
        member = rows["member"].to_numpy(bool)
        own = np.unique(place[member])
        root = link(points.view("<u8"), own, np.unique(place[~member]), radius)
        moved = np.flatnonzero(root != np.arange(len(points)))
        return pd.DataFrame({"u": points[moved], "v": points[root[moved]]})

    return map_groups(as_member.union(as_guest), ["leaf", "i", "j"], search, "u long, v long")


def _grouped(marked: DataFrame, doc_id: str, radius: int) -> DataFrame:
    """``fp, root, component_id`` for every distinct fingerprint."""
    distinct = staged(marked.groupBy("fp").agg(F.min(doc_id).alias("least")), "distinct")
    roots = component_roots(links(distinct, radius)).withColumnRenamed("node", "fp")
    member = staged(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    return member.join(member.groupBy("root").agg(F.min("least").alias("component_id")), "root").drop("least")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    ``fingerprint`` is 16 hexadecimal digits; rows link if theirs differ in ``radius`` bits at
    most, texts without words (null among them) having fingerprint zero. ``component_id`` is
    the smallest ``doc_id`` reachable over links, null only if all are null. Repeated rows
    are rows of their own in the same component. Other columns are not read. An empty table
    gives an empty result.
    """
    marked = staged(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), "fingerprints")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return marked.join(_grouped(marked, "doc_id", radius), "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row left of each component: that of the smallest ``doc_id``, null last."""
    row = fresh_name(docs, "row")
    kept = staged(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    narrow = kept.select(F.col(row).alias("__row"), F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    marked = staged(fingerprints(narrow, ("__row", "__id"), "__text"), "fingerprints")
    grouped = marked.join(_grouped(marked, "__row", radius), "fp")
    first = F.min(F.struct(F.col("__id").isNull(), "__id", "__row"))["__row"]
    chosen = grouped.groupBy("root").agg(first.alias(row)).select(row)
    return kept.join(chosen, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
