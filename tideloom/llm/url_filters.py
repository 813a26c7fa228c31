"""URL filters by Bloom filter cascades, by DataFrame functions alone.

A list of keys (hosts, or hosts with the beginning of a path) is encoded against all keys that
the corpus has. Level 1 is a Bloom filter of the listed keys; level 2 holds the corpus's other
keys that level 1 takes for listed, level 3 the listed keys that level 2 takes for others, and
so on until a level deceives no key. A key belongs to the list if the number of levels that
know it, up to the first that does not, is odd. For the keys it was built over that is exact,
so that a url is judged by looking at bits that travel with the expression: no join.

Level 1 lets through about as many other keys as there are listed ones (their ratio sets its
bits a key), each further level halves what is left. So the size of a cascade follows from the
listed keys and the logarithm of the ratio. A list whose bits exceed ``MOST_BYTES`` is looked
up by an equal join instead.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Bytes of all levels of one cascade that may travel with a plan: some ten million listed keys.
MOST_BYTES = 16 << 20
#: Bits that ``bitmap_construct_agg`` gathers in one row.
BUCKET_BITS = 32768
LEAST_BITS = 64
BLOCK, ALLOW = "block", "allow"


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path of a url; empty if it is null or has no ``://``."""
    after = F.expr(f"IF(instr(`{url}`, '://') > 0, substr(`{url}`, instr(`{url}`, '://') + 3), '')")
    rest = F.coalesce(after, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def shapes(keys: DataFrame) -> list[tuple[int, int]]:
    """The distinct numbers of labels and of path characters among ``host, path`` rows, longest first.

    Urls are probed once for each; their lengths bound them, not the number of rows.
    """
    found = keys.select(_labels(F.col("host")).alias("labels"), F.length("path").alias("chars")).distinct().collect()
    return sorted(((r.labels, r.chars) for r in found), reverse=True)


def candidates(host: Column, path: Column, forms: list[tuple[int, int]]) -> Column:
    """The keys of the given shapes that fit a url: ends of its host with beginnings of its path."""
    made = [
        F.when((_labels(host) >= labels) & (F.length(path) >= chars) & (host != ""), F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, chars)))
        for labels, chars in forms
    ]
    return F.array_compact(F.array(*made)) if made else F.expr("cast(array() AS array<string>)")


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    held: bytes


def _place(key: Column, level: int, bits: int, turn: int) -> Column:
    """One of a key's bits of a level: double hashing of two 64-bit hashes of its own."""
    one, two = (F.pmod(F.xxhash64(F.lit(2 * level + i), key), F.lit(bits)) for i in (0, 1))
    return (one + F.lit(turn).cast("long") * (two + 1)) % F.lit(bits)


def _known(key: Column, number: int, level: Level) -> Column:
    known = F.lit(True)
    for turn in range(level.hashes):
        place = _place(key, number, level.bits, turn)
        byte = F.conv(F.hex(F.substring(F.lit(level.held), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        known = known & (F.getbit(byte.cast("long"), (place % 8).cast("int")) == 1)
    return known


def _size(keys: int, share: float) -> tuple[int, int]:
    """Bits and hashes of a Bloom filter of so many keys that takes at most that share of other keys for its own."""
    each = math.log2(1 / min(share, 0.5))
    bits = max(LEAST_BITS, math.ceil(keys * each / math.log(2)))
    return -(-bits // 8) * 8, max(1, round(each))


def _level(keys: DataFrame, number: int, bits: int, hashes: int) -> Level:
    places = keys.select(F.explode(F.array(*[_place(F.col("key"), number, bits, turn) for turn in range(hashes)])).alias("place"))
    built = places.groupBy(F.floor(F.col("place") / BUCKET_BITS).alias("bucket")).agg(F.bitmap_construct_agg(F.col("place") % BUCKET_BITS).alias("bits"))
    held = bytearray(-(-bits // BUCKET_BITS) * BUCKET_BITS // 8)
    for row in built.collect():  # the level's bits, in rows of 4 KiB
        held[row.bucket * BUCKET_BITS // 8 : (row.bucket + 1) * BUCKET_BITS // 8] = row.bits
    return Level(bits, hashes, bytes(held[: bits // 8]))


class Cascade:
    """Exact membership in a list, for the keys of a universe."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def of(cls, listed: DataFrame, universe: DataFrame, most_bytes: int = MOST_BYTES) -> Cascade | None:
        """The cascade of the column ``key`` of ``listed`` over that of ``universe``; none if it would exceed ``most_bytes``.

        Null keys belong to neither. Listed keys that the universe lacks are left out; no key of
        either reaches the driver.
        """
        marked = listed.select("key", F.lit(1).alias("listed"), F.lit(0).alias("seen")).unionByName(universe.select("key", F.lit(0).alias("listed"), F.lit(1).alias("seen")))
        keys = marked.where("key IS NOT NULL").groupBy("key").agg(F.max("listed").alias("listed"), F.max("seen").alias("seen"))
        left = staged(keys.where("seen = 1").drop("seen"), "url_keys")
        size = left.agg(F.count_if(F.col("listed") == 1).alias("own"), F.count_if(F.col("listed") == 0).alias("others")).first()
        ours, others = size.own, size.others
        if not ours:
            return cls([])
        # As many others as about 0.7 of the listed keys come through: what makes both first levels smallest.
        bits, hashes = _size(ours, math.sqrt(0.5) * ours / max(others, 1))
        # All later levels halve what is left: together they hold less than four keys for each listed one.
        if (bits + 6 * ours) / 8 > most_bytes:
            return None
        levels: list[Level] = []
        side = 1
        while ours:
            levels.append(_level(left.where(F.col("listed") == side), len(levels), bits, hashes))
            known = _known(F.col("key"), len(levels) - 1, levels[-1])
            # A level's own keys stay for the next one to be told from; of the others, those it deceives.
            left = staged(left.where((F.col("listed") == side) | known), "url_keys")
            side = 1 - side
            ours = left.where(F.col("listed") == side).count()
            bits, hashes = _size(ours, 0.5)
        return cls(levels)

    @property
    def bytes(self) -> int:
        return sum(len(level.held) for level in self.levels)

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed; false for null."""
        found = F.lit(len(self.levels) % 2 == 1)
        for number in reversed(range(len(self.levels))):
            found = F.when(~_known(key, number, self.levels[number]), F.lit(number % 2 == 1)).otherwise(found)
        return F.coalesce(key.isNotNull() & found, F.lit(False))


def with_listed(df: DataFrame, keys: str, listed: DataFrame, into: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Replace the array ``keys`` by ``into``: its first element that ``listed`` (a column ``key``) has, or null.

    Every key of the arrays is in the universe of the cascade, so that this is exact. The table
    is read twice, so stage it first if it is costly.
    """
    universe = df.select(F.explode(keys).alias("key")).distinct()
    cascade = Cascade.of(listed, universe, most_bytes)
    if cascade is not None:
        return df.withColumn(into, F.element_at(F.concat(F.filter(keys, lambda k: cascade.contains(k)), F.array(F.lit(None).cast("string"))), 1)).drop(keys)
    numbered = staged(df.withColumn("__n", F.monotonically_increasing_id()), "urls")
    probed = numbered.select("__n", F.posexplode(keys).alias("__at", "key")).join(listed.select("key").distinct(), "key", "left_semi")
    first = probed.groupBy("__n").agg(F.min_by("key", "__at").alias(into))
    return numbered.drop(keys, into).join(first, "__n", "left").drop("__n")


def judged(pages: DataFrame, rules: DataFrame, blocklist: DataFrame, page_id: str = "page_id", url: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row.

    ``rules`` has ``host, path, verdict`` (block or allow). A rule fits its host and all
    subdomains if the url's path starts with the rule's; the longest that fits decides, among
    equally long ones the one with most labels, a key listed with both verdicts allows.
    ``rule`` is its host and path. Without one, a url is blocked if ``blocklist`` (a column
    ``host``) has its host or one above it, and allowed otherwise.

    A null url, one without ``://`` or without a host fits no rule and is allowed. Repeated rows
    are judged alike; null rules and listed hosts are ignored; other columns are not read,
    whatever their names; an empty table gives an empty result, an empty list blocks nothing.
    """
    host, path = parts(url)
    split = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rules = rules.where("host IS NOT NULL AND host <> '' AND path IS NOT NULL").withColumn("key", F.concat("host", "path"))
    hosts = blocklist.where("host IS NOT NULL AND host <> ''").select("host").distinct()
    ruled = shapes(rules)
    listed = shapes(hosts.withColumn("path", F.lit("")))
    # Longest first; the sort is stable, so that of equally long keys the one with most labels comes first.
    fitting = F.array_sort(candidates(F.col("host"), F.col("path"), ruled), lambda a, b: F.length(b) - F.length(a))
    probes = staged(split.withColumn("__rules", fitting).withColumn("__hosts", candidates(F.col("host"), F.col("path"), listed)), "urls")
    allowed = rules.where(F.col("verdict") == ALLOW).select("key")
    found = with_listed(probes, "__rules", rules.select("key"), "rule", most_bytes)
    # Whether the rule found allows: the same test for one key.
    one = F.when(F.col("rule").isNotNull(), F.array("rule")).otherwise(F.expr("cast(array() AS array<string>)"))
    found = with_listed(found.withColumn("__allow", one), "__allow", allowed, "__allows", most_bytes)
    found = with_listed(found, "__hosts", hosts.select(F.col("host").alias("key")), "__listed", most_bytes)
    blocks = F.when(F.col("rule").isNotNull(), F.col("__allows").isNull()).otherwise(F.col("__listed").isNotNull())
    return found.select("page_id", "host", "path", "rule", F.when(blocks, BLOCK).otherwise(ALLOW).alias("verdict"))
