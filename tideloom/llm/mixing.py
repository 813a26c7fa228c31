"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots, each a block of equally many words. Slot ``t`` stands at the
golden-ratio point ``frac(t / phi)``, which the sources' cumulative targets map to a source;
the slots of a source, ranked, take the blocks of that source's shuffled documents, laid end
to end and repeated as often as the target asks. Every stretch of the mix thus has the
sources near their weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, map_batches, running_start, staged

WEIGHTS = (1.0, 2.0, 3.0)
MAX_REPEATS = 3
BLOCK_WORDS = 64
SEED = 7
_BUCKET_ROWS, _FULL = 4096, 4
_BANDS, _BAND_WORDS = 1 << 15, 1 << 20
_SLOTS = 65536
_GOLDEN = np.uint64(11400714819323198485)  # 2**64 / phi


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_no, source_size, target, quota`` for each source, numbered by code point, null last.

    The weights repeat in this order. Shares of the total go by weight; a target stops at
    ``repeats`` times its source's size, and the excess goes to the others by weight, round by
    round, until none is above. A round sends the driver one row of sums for each weight, so
    that there may be any number of sources. The quota is the target in whole words.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Parts are ranges of sources in order, so that numbering them takes no single task.
    parts = staged(sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    numbered = running_start(parts, [], "part", [F.col("source").asc_nulls_last()], F.lit(1), "source_no").drop("part")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    numbered = numbered.withColumn("turn", F.pmod("source_no", F.lit(len(weights)))).withColumn("weight", listed[F.col("turn")])
    sources = staged(numbered.withColumn("cap", F.col("source_size") * repeats), "sources")
    stopped, before = F.lit(False), -1
    while True:
        rows = sources.groupBy("turn").agg(
            F.sum("source_size").alias("size"), F.sum(F.when(stopped, F.col("cap")).otherwise(0)).alias("kept"), F.count_if(stopped).alias("stopped"), F.count_if(~stopped).alias("open"),
        ).orderBy("turn").collect()
        rest, weight = float(sum(r["size"] - r.kept for r in rows)), float(sum(r.open * weights[r.turn] for r in rows))
        found = sum(r.stopped for r in rows)
        share = F.lit(rest) * F.col("weight") / F.lit(weight or 1.0)
        if found == before or not weight:
            break
        # The share of a weight only rises, so that a source which stops stays stopped.
        before, stopped = found, share > F.col("cap")
    target = F.when(stopped, F.col("cap").cast("double")).otherwise(share)
    quota = F.least("cap", F.bround(target).cast("long"))
    return staged(sources.select("source", F.col("source_no").cast("int").alias("source_no"), "source_size", target.alias("target"), quota.alias("quota")), "targets")


def first_hit(start: int, low: int, high: int) -> int:
    """The first slot from ``start`` on whose golden-ratio point is in ``low`` to ``high`` (of 2**64, end inclusive)."""
    whole = 1 << 64
    at = start * int(_GOLDEN) % whole
    if low <= at <= high:
        return start

    def least(step: int, size: int, low: int, high: int) -> int:
        """The least x for which x * step modulo size is in the range, by Euclid's descent."""
        if low == 0:
            return 0
        if 2 * step > size:
            return least(size - step, size, size - high, size - low)
        x = -(-low // step)
        if x * step <= high:
            return x
        return -(-(low + size * least(-size % step, step, low % step, high % step)) // step)

    # The range, seen from the start's own point, does not hold 0, so that it does not wrap around.
    return start + least(int(_GOLDEN), whole, (low - at) % whole, (high - at) % whole)


def _intervals(sources: DataFrame, total: int, block: int) -> DataFrame:
    """``source_no, blocks, low, high`` (end inclusive) of the sources with words; points are of 2**64, less 2**63.

    Whole numbers: a quotient of floats may round up to 1, which is beyond the last point.
    """
    held = sources.where("quota > 0").withColumn("part", F.expr(f"source_no div {_SLOTS}"))
    laid = running_start(held, [], "part", [F.col("source_no")], F.col("quota"), "before").select("source_no", "quota", "before")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, quotas, before = (batch.column(i).to_pylist() for i in range(3))
            low = [(b << 64) // total - (1 << 63) for b in before]
            high = [((b + q) << 64) // total - 1 - (1 << 63) for b, q in zip(before, quotas, strict=True)]
            columns = [pa.array(numbers, pa.int32()), pa.array([-(-q // block) for q in quotas], pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["source_no", "blocks", "low", "high"])

    return staged(map_batches(laid, cut, "source_no int, blocks long, low long, high long"), "intervals")


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = batch.column(0).to_numpy()
        points = (slots.astype(np.uint64) * _GOLDEN ^ np.uint64(1 << 63)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(points)], ["slot", "at"])


def _further(drawn: int) -> Callable:
    """The blocks that a source lacks, in the next slots of its interval."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for number, blocks, low, high, had in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                slot = drawn - 1
                for rank in range(had, blocks):
                    slot = first_hit(slot + 1, low + (1 << 63), high + (1 << 63))
                    found.append((slot, number, rank))
            columns = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64()), strict=True)], ["slot", "source_no", "rank"])

    return place


def schedule(sources: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """``slot, source_no, rank``: the golden-ratio schedule for sources of these word quotas (``source_no, quota``).

    A slot's point meets the interval that begins last at or before it: points and beginnings
    are sorted together in bands of the points' range, an interval beginning anew in each band
    it reaches, so that neither a table of sources nor a join by range is needed. A band has
    some 16,000 points and as many beginnings as it has words at most; there are 65,536 bands
    at most. A quarter more slots are drawn than the quotas need, and those beyond a source's
    quota are left out. A small source may have none or too few among them: its missing blocks
    take the next slots whose points are in its interval, however far they are, so that
    every source comes to its quota.
    """
    spark = sources.sparkSession
    total = sources.agg(F.sum(F.when(F.col("quota") > 0, F.col("quota")))).first()[0] or 0
    intervals = _intervals(sources, total, block)
    needed = -(-total // block)
    drawn = needed + needed // 4 + 256 if total else 0
    bits = max(1, min(_BANDS, total // _BAND_WORDS).bit_length())
    band = lambda name: F.shiftright(name, 64 - bits)
    begins = intervals.select("source_no", "low", F.explode(F.sequence(band("low"), band("high"))).alias("band"))
    begins = begins.select("band", F.greatest("low", F.shiftleft("band", 64 - bits)).alias("at"), F.lit(None).cast("long").alias("slot"), "source_no")
    points = map_batches(spark.range(drawn), _drawn, "slot long, at long").select(band("at").alias("band"), "at", "slot", F.lit(None).cast("int").alias("source_no"))
    so_far = Window.partitionBy("band").orderBy("at", F.col("slot").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    met = begins.unionByName(points).withColumn("source_no", F.last("source_no", ignorenulls=True).over(so_far)).where("slot IS NOT NULL")
    slots = staged(met.select("slot", "source_no", F.expr(f"slot div {_SLOTS}").alias("part")), "slots")
    ranked = running_start(slots, ["source_no"], "part", [F.col("slot")], F.lit(1), "rank").select("slot", "source_no", F.col("rank").cast("long").alias("rank"))
    had = intervals.join(slots.groupBy("source_no").agg(F.count("*").alias("had")), "source_no", "left")
    had = had.select("source_no", "blocks", "low", "high", F.coalesce("had", F.lit(0)).alias("had"))
    return ranked.unionByName(map_batches(had, _further(drawn), "slot long, source_no int, rank long"))


def _even(sized: DataFrame) -> DataFrame:
    """Buckets with many times their rows, as repeated rows have, in parts by a hash of the row."""
    full = staged(sized.groupBy("source_no", "bucket").count().where(F.col("count") > _FULL * _BUCKET_ROWS), "full")
    split = full.select("source_no", "bucket", F.expr(f"`count` div {_BUCKET_ROWS}").alias("split"))
    part = F.pmod(F.xxhash64("row"), F.coalesce("split", F.lit(1)))
    return sized.join(split, ["source_no", "bucket"], "left").withColumn("bucket", F.struct("bucket", part.alias("part"))).drop("split")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = MAX_REPEATS, block: int = BLOCK_WORDS, doc_id: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents with their sizes and targets, and the mix.

    The first result has, for every row, ``row`` (a number of its own, or the column so named), ``doc_id``, ``size``
    in words (null text: 0), ``source_size`` and ``target``. The second has a row for each
    stretch of a document in the mix: ``slot, source_no, row, doc_id, first, last`` (words,
    end exclusive), ``turn`` (from 0; at most ``repeats`` turns). Null sources are one source;
    repeated rows are rows of their own; rows without words are in no slot. An empty table
    gives two empty results. Reruns agree.
    """
    spark = docs.sparkSession
    shuffle_key = F.xxhash64(F.lit(SEED), doc_id, text)
    rows = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
        word_count(F.col(text)).alias("size"), shuffle_key.alias("key"),
    )
    rows = staged(rows, "sizes")
    sources = source_targets(rows, weights, repeats)
    # Spark broadcasts the sources if their staged files are small, else it shuffles and splits a hot source.
    sized = rows.withColumnRenamed("source", "own").join(sources, F.col("own").eqNullSafe(F.col("source"))).drop("own", "source")
    buckets = max(1, -(-rows.count() // _BUCKET_ROWS))
    sized = _even(sized.withColumn("bucket", F.pmod("key", F.lit(buckets))))
    order = [F.col("key"), F.col("doc_id"), F.col("size"), F.col("row")]
    laid = staged(running_start(sized, ["source_no"], "bucket", order, F.col("size"), "start"), "laid")
    turns = laid.where("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    turns = turns.withColumn("from", F.col("start") + F.col("turn") * F.col("source_size")).where("from < quota")
    turns = turns.withColumn("to", F.least(F.col("from") + F.col("size"), "quota"))
    stretch = turns.withColumn("rank", F.explode(F.sequence(F.expr(f"`from` div {block}"), F.expr(f"(`to` - 1) div {block}"))))
    stretch = stretch.select(
        "source_no", "rank", "row", "doc_id", F.col("turn"),
        (F.greatest("from", F.col("rank") * block) - F.col("from")).alias("first"),
        (F.least("to", (F.col("rank") + 1) * block) - F.col("from")).alias("last"),
    )
    placed = schedule(sources, block).join(stretch, ["source_no", "rank"]).select("slot", "source_no", "row", "doc_id", "turn", "first", "last")
    return laid.select("row", "doc_id", "size", "source_size", "target"), placed


def words_taken(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row: the words the mix takes of it, repeats counted."""
    sized, placed = mix(docs, **how)
    taken = placed.groupBy("row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    return sized.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix takes them: each row once for every turn in which it has words, left out if none.

    Whole documents: one that the mix cuts at the end of its source's quota stays whole.
    """
    row = fresh_name(docs, "row")
    kept = staged(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    _, placed = mix(kept, **how, row=row)
    turns = placed.select(F.col("row").alias(row), "turn").distinct().select(row)
    return kept.join(turns, row).select(*[F.col(f"`{c}`") for c in docs.columns])
