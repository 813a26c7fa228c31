"""Raw objects as DataFrames, in batch and as a stream."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.transform import CORRUPT_COLUMN
from ..workspace import fresh_path, setting

# Readable formats and the batch size of a poll.
FORMATS = ("json", "parquet")
BATCH_CAP = 10
# What a micro-batch reads unless a number of files is given.
BATCH_BYTES = 1 << 30
# A listing opens folders one by one while a level has fewer than MANY; then tasks list GROUP of them at a time.
MANY = 256
GROUP = 32768


def _checked(fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"unknown source format {fmt}; expected one of {FORMATS}")
    return fmt


def _with_corrupt(schema: T.StructType, fmt: str) -> T.StructType:
    if fmt != "json" or CORRUPT_COLUMN in schema.names:
        return schema
    return T.StructType([*schema.fields, T.StructField(CORRUPT_COLUMN, T.StringType())])


def read_batch(
    spark: SparkSession, paths: Sequence[str], fmt: str = "json", schema: T.StructType | None = None
) -> DataFrame:
    """All files below the given paths in one scan.

    Each path is read once however often it is listed, since notifications
    arrive at least once. Without a schema one is inferred from all files; with
    one, unreadable JSON lines are kept whole in ``_corrupt_record``.
    """
    _checked(fmt)
    distinct = list(dict.fromkeys(paths))
    if not distinct:
        return spark.createDataFrame([], schema or T.StructType([]))
    reader = spark.read.option("recursiveFileLookup", "true")
    if schema is not None:
        reader = reader.schema(_with_corrupt(schema, fmt))
    if fmt == "json":
        return reader.option("columnNameOfCorruptRecord", CORRUPT_COLUMN).json(distinct)
    if schema is None:
        reader = reader.option("mergeSchema", "true")
    return reader.parquet(*distinct)


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", max_files: int | None = None, max_bytes: int = BATCH_BYTES
) -> DataFrame:
    """The files below a path as a stream of micro-batches of about ``max_bytes``, or of at most ``max_files`` files."""
    cap = ("maxFilesPerTrigger", str(max_files)) if max_files else ("maxBytesPerTrigger", str(max_bytes))
    return (
        spark.readStream.format(_checked(fmt))
        .schema(_with_corrupt(schema, fmt))
        .option("recursiveFileLookup", "true")
        .option(*cap)
        .option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
        .load(path)
    )


def with_provenance(df: DataFrame) -> DataFrame:
    """Append the file each row was read from and when that file was written."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_source_path"),
        F.col("_metadata.file_modification_time").alias("_source_modified"),
    )


def list_objects(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """Every file below ``root`` whose relative path has the prefix; none if the root is absent."""
    from ..sinks.storage import Storage

    schema = "path string, key string, length long, modificationTime timestamp"
    # Only what begins with the prefix is listed; characters that a pattern would read otherwise are escaped.
    where = f"{root.rstrip('/')}/{_literal(prefix)}*" if prefix else root
    storage = Storage(spark)
    level = storage.matching(where) if prefix else [root] * storage.exists(root)
    if not level:
        return spark.createDataFrame([], schema)
    groups = _groups(storage, level)
    some, more = next(groups), next(groups, None)
    if more is None:
        return _listed(spark, some, root, prefix)
    # The driver knows the objects of one group at a time, however many there are in all.
    staged = fresh_path(spark, "listing")
    for group in chain((some, more), groups):
        _listed(spark, group, root, prefix).write.mode("append").parquet(staged)
    return spark.read.schema(schema).parquet(staged)


def _groups(storage, level: list[str]) -> Iterator[list[str]]:
    """Folders and files below which all objects are, at most ``GROUP`` in a group and one group at least.

    Folders are opened level by level until there are many of them.
    """
    while len(level) < MANY:
        below: list[str] = []
        many = False
        for at in level:
            below += [p for p in storage.entries(at) if not _hidden(p)]
            many = many or len(below) >= GROUP
            while len(below) >= GROUP:
                yield below[:GROUP]
                below = below[GROUP:]
        if many or not below or below == level:  # a file has itself below it
            if below or not many:
                yield below or level
            return
        level = below
    for i in range(0, len(level), GROUP):
        yield level[i : i + GROUP]


def _listed(spark: SparkSession, paths: list[str], root: str, prefix: str) -> DataFrame:
    """The objects below some folders and files, listed by few tasks and read by few."""
    tasks = 3 * spark.sparkContext.defaultParallelism
    # One text for all paths, since a call for each would take long; no path has a zero in it.
    jvm = spark._jvm
    array = jvm.org.apache.commons.lang3.StringUtils.splitByWholeSeparator("\0".join(map(_literal, paths)), "\0")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    with setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", str(tasks)):
        found = reader._df(reader._jreader.load(array)).coalesce(tasks)
    # Paths come back with the scheme of their file system in front.
    below = F.element_at(F.split(F.col("path"), F.concat(F.lit("\\Q"), F.lit(_bare(root) + "/"), F.lit("\\E"))), -1)
    listed = found.select("path", below.alias("key"), "length", "modificationTime")
    return listed.where(F.col("key").startswith(prefix)) if prefix else listed


def _literal(path: str) -> str:
    return re.sub(r"[][*?{}^,\\]", r"\\\g<0>", path)


def _hidden(path: str) -> bool:
    """Names that Spark leaves out of a listing."""
    name = path.rpartition("/")[2]
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _bare(path: str) -> str:
    without_scheme = path.split("://", 1)[-1] if "://" in path else path.removeprefix("file:")
    return without_scheme.rstrip("/")
