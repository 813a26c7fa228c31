"""Shared steps: tables in the shared folder, running sums without a hot group, connected components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import fresh_path


_BATCH_SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver runs; Spark serves the file to them."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tideloom-code-"), "tideloom_code.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    archive.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(package)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def _bound_batches(spark: SparkSession) -> None:
    """Arrow batches of a few megabytes, unless the session names a size.

    An executor's tasks and their workers hold several batches each, outside the heap, in
    buffers that stay once they have grown.
    """
    if _BATCH_SIZE not in spark.conf.getAll:
        spark.conf.set(_BATCH_SIZE, str(BATCH_BYTES))


def _give_back() -> None:
    """Return what a task has freed to the system; the worker lives on and serves other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library keeps its memory
        pass


def map_batches(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInArrow`` over batches of bounded size, whose workers give back the memory of each task."""

    def freeing(batches):
        try:
            yield from function(batches)
        finally:
            _give_back()

    _ship(df.sparkSession)
    _bound_batches(df.sparkSession)
    return df.mapInArrow(freeing, schema)


def map_groups(df: DataFrame, keys: Sequence[str], function: Callable, schema: str) -> DataFrame:
    _ship(df.sparkSession)
    return df.groupBy(*keys).applyInPandas(function, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name like the given one that the table does not have, whatever its case."""
    held = {c.lower() for c in df.columns}
    while f"__{name}".lower() in held:
        name += "_"
    return f"__{name}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write to the folder all executors share and read back: later steps need no recomputation if executors are lost.

    Some steps stage whole texts, which outlive them, so that the files are packed tightly.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_start(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column], value: Column, into: str) -> DataFrame:
    """Add the sum of ``value`` over the rows before a row, within ``group``, by ``bucket`` and then by ``order``.

    A group may hold most rows of the table: only the rows of one bucket of one group are
    sorted together, the starts of buckets come from one sum per bucket.
    """
    group = list(group)
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.col(bucket).alias("__b"),
        F.coalesce(F.sum("__sum").over(before), F.lit(0)).cast("long").alias("__start"),
    )
    own = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("__own", F.coalesce(F.sum(value).over(own), F.lit(0)).cast("long"))
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)] + [F.col(bucket) == F.col("__b")]
    joined = inner.join(starts, _all(same))
    return joined.withColumn(into, F.col("__start") + F.col("__own")).drop(
        "__own", "__start", "__b", *[f"__g{i}" for i in range(len(group))]
    )


def _all(conditions: Sequence[Column]) -> Column:
    found = conditions[0]
    for other in conditions[1:]:
        found = found & other
    return found


def component_roots(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """``node, root`` for every node of an undirected graph; nodes of one component share a root.

    Every round each node joins its neighbour of least random priority and the graph is
    contracted, so that a constant share of the nodes goes, whatever the graph's shape.
    Hubs cost no more than their edges: neighbours are reduced by partial aggregation and
    the joins have one row per node on one side.
    """
    current = staged(edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v").distinct(), "edges")
    steps: list[DataFrame] = []
    turn = 0
    while not current.isEmpty():
        turn += 1
        both = current.union(current.select("v", "u"))
        rank = lambda name, turn=turn: F.struct(F.xxhash64(F.lit(turn), name).alias("h"), F.col(name).alias("n"))
        step = staged(
            both.groupBy("u").agg(F.min(rank("v")).alias("best")).select(F.col("u").alias("node"), F.least(rank("u"), "best")["n"].alias("next")),
            "components",
        )
        steps.append(step)
        ends = [step.select(F.col("node").alias(x), F.col("next").alias(f"{x}{x}")) for x in ("u", "v")]
        moved = current.join(ends[0], "u").join(ends[1], "v").where("uu <> vv")
        current = staged(moved.select(F.least("uu", "vv").alias("u"), F.greatest("uu", "vv").alias("v")).distinct(), "edges")
    if not steps:
        return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = steps[0].select("node", F.col("next").alias("root"))
    for step in steps[1:]:
        following = step.select(F.col("node").alias("root"), F.col("next").alias("__next"))
        roots = roots.join(following, "root", "left").select("node", F.coalesce("__next", "root").alias("root"))
    return roots
