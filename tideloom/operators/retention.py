"""Which stored files may go and which should be packed, as queries over file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _cutoffs(touches: DataFrame, group: str, commit: str, retained: int) -> DataFrame:
    """Per group the oldest commit still retained; groups with fewer commits have none."""
    newest = Window.partitionBy(group).orderBy(F.col(commit).desc())
    return (
        touches.select(group, commit)
        .distinct()
        .withColumn("__rank", F.row_number().over(newest))
        .where(F.col("__rank") <= retained)
        .groupBy(group)
        .agg(F.min(commit).alias("__cutoff"), F.count("*").alias("__n"))
        .where(F.col("__n") == retained)
    )


def expirable_by_versions(
    files: DataFrame, retained: int = 3, partition: str = "part_key", added: str = "added", removed: str = "removed"
) -> DataFrame:
    """Files that no retained version of their partition needs.

    ``files`` has one row per file with the commit that added it and the commit
    that removed it (null while it is live). A partition has a version for each
    commit that changed it; its newest ``retained`` versions stay readable.
    """
    touches = files.select(partition, F.col(added).alias("__commit")).unionByName(
        files.where(F.col(removed).isNotNull()).select(partition, F.col(removed).alias("__commit"))
    )
    cutoffs = _cutoffs(touches, partition, "__commit", retained).withColumnRenamed(partition, "__part")
    needed_no_more = F.col(partition).eqNullSafe(F.col("__part")) & (F.col(removed) <= F.col("__cutoff"))
    return files.join(cutoffs, needed_no_more, "left_semi")


def expirable_by_commits(
    files: DataFrame, commits: DataFrame, retained: int = 5, commit: str = "seq", removed: str = "removed"
) -> DataFrame:
    """Files that none of the newest ``retained`` states of the table needs."""
    newest = commits.select(commit).distinct().orderBy(F.col(commit).desc()).limit(retained)
    oldest_kept = newest.agg(F.when(F.count("*") == retained, F.min(commit)).alias("cutoff"))
    return files.where(F.col(removed) <= oldest_kept.scalar())


def small_file_candidates(
    files: DataFrame, limit_bytes: int = 104857600, partition: str = "part_key", size: str = "bytes"
) -> DataFrame:
    """Files below the limit in partitions that have more than one of them."""
    small = files.where(F.col(size) < limit_bytes)
    crowded = (
        small.groupBy(partition).count().where(F.col("count") > 1).select(F.col(partition).alias("__part"))
    )
    return small.join(crowded, F.col(partition).eqNullSafe(F.col("__part")), "left_semi")
