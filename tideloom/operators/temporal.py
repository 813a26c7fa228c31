"""Joins by time: the row in force at a time, and the times within intervals.

Keys may hold most rows of a table. Times are dealt to bins of equal length, so that what is
sorted or joined together is the rows of one key and bin; what is in force when a bin begins
comes from one row for each key and bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400
#: Points of one key and bin that meet the bin's intervals in one group of rows.
GROUP_ROWS = 100_000


def _bin(at: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def in_force(
    requests: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    at: str,
    since: str,
    values: Sequence[str],
    bin_seconds: int = 30 * DAY,
) -> DataFrame:
    """Every request with the ``values`` of its key's latest history row no later than its time.

    Of history rows of one time the one with the greatest values counts (nulls least). A request
    without a key, a time or an earlier row has nulls. Both sides are sorted together once, no
    pairs are made. ``keys`` are columns of both sides; names beginning with ``__asof`` are taken.
    """
    complete = F.lit(True)
    for name in (*keys, at):
        complete = complete & F.col(name).isNotNull()
    asked = requests.where(complete).select(*keys, F.col(at).cast("timestamp").alias("__asof_at"), F.struct(*requests.columns).alias("__asof_row"))
    known = history.select(*keys, F.col(since).cast("timestamp").alias("__asof_at"), F.struct(*values).alias("__asof_value"))
    known = known.dropna(subset=[*keys, "__asof_at"])
    both = asked.unionByName(known, allowMissingColumns=True).withColumn("__asof_bin", _bin("__asof_at", bin_seconds))

    cell = [*keys, "__asof_bin"]
    # Of a history row and a request of one time the history row is first.
    order = [F.col("__asof_at"), F.col("__asof_row").isNotNull(), F.col("__asof_value").asc_nulls_first()]
    so_far = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("__asof_own", F.last("__asof_value", ignorenulls=True).over(so_far)).where(F.col("__asof_row").isNotNull())

    ordered = F.when(F.col("__asof_value").isNotNull(), F.struct("__asof_at", "__asof_value"))
    ends = both.groupBy(*cell).agg(F.max(ordered)["__asof_value"].alias("__asof_end"))
    before = Window.partitionBy(*keys).orderBy("__asof_bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*cell, F.last("__asof_end", ignorenulls=True).over(before).alias("__asof_start"))

    found = own.join(ends, cell).select("__asof_row.*", F.coalesce("__asof_own", "__asof_start").alias("__asof_found"))
    found = found.select(*requests.columns, *[F.col("__asof_found")[name].alias(name) for name in values])
    return found.unionByName(requests.where(~complete), allowMissingColumns=True)


def within(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    at: str,
    begin: str,
    end: str,
    bin_seconds: int = 30 * DAY,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Every pair of a point and an interval of its key with ``begin <= at < end``: all columns, the keys once.

    An interval has a row for each bin it reaches that has points of its key, a point is in one
    bin, so that an equal join finds each pair once. The points of a bin with more than
    ``group_rows`` are dealt to several groups, to each of which the bin's intervals go. Rows
    with a null key or time match nothing. Names beginning with ``__in`` are taken.
    """
    cell = [*keys, "__in_bin"]
    placed = points.withColumn("__in_bin", _bin(at, bin_seconds)).dropna(subset=cell)
    groups = placed.groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(group_rows)).cast("int").alias("__in_groups"))
    crowded = groups.where("__in_groups > 1")
    # By content, so that a task run again deals the same rows to the same groups; maps have no hash.
    content = [f.name for f in points.schema.fields if "map<" not in f.dataType.simpleString()]
    dealt = placed.join(crowded, cell, "left").withColumn("__in_group", F.pmod(F.xxhash64(*content), F.coalesce("__in_groups", F.lit(1))).cast("int"))
    real = intervals.where(F.col(begin) < F.col(end))
    # The last instant before the end decides on the last bin.
    final = F.floor((F.unix_micros(F.col(end).cast("timestamp")) - 1) / F.lit(bin_seconds * 1_000_000)).cast("long")
    reached = real.withColumn("__in_bin", F.explode(F.sequence(_bin(begin, bin_seconds), final)))
    reached = reached.join(groups, cell).withColumn("__in_group", F.explode(F.sequence(F.lit(0), F.col("__in_groups") - 1)))
    joined = dealt.drop("__in_groups").join(reached.drop("__in_groups"), [*cell, "__in_group"])
    return joined.where((F.col(begin) <= F.col(at)) & (F.col(at) < F.col(end))).drop("__in_bin", "__in_group")
