"""Rows as raw objects: a folder with one JSON file for each value of some columns."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Storage

# The folder of a null or empty value, and the characters that a folder has as %XX: as Spark's writer names them.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]")


def write_objects(df: DataFrame, path: str, by: Sequence[str], tasks: int) -> None:
    """An object for each value of the columns ``by``, as a partitioned write of JSON would lay them out below a fresh path."""
    local = Storage(df.sparkSession).local(path)
    if local is None:
        df.repartition(tasks, *by).write.partitionBy(*by).json(path)
        return
    # On a local disk Hadoop starts a process for the mode of each folder and each file and keeps a checksum file
    # beside each object, far more than the work on the object itself; so there the tasks write the files themselves.
    text = {c: F.col(c).cast("string") for c in by}
    values = [F.coalesce(F.when(text[c] != "", text[c]), F.lit(NO_VALUE)).alias(c) for c in by]
    line = F.to_json(F.struct(*(c for c in df.columns if c not in by))).alias("line")
    rows = df.select(*values, line).repartition(tasks, *by).sortWithinPartitions(*by)
    rows.mapInArrow(_writing(local, list(by)), "objects long").write.format("noop").mode("overwrite").save()


def _writing(root: str, by: list[str]):
    """What a task does; all of it goes along with the function, since executors may not have this module."""
    run = uuid.uuid4()

    def folder(values: Iterable[str]) -> str:
        parts = (f"{c}={_ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', v)}" for c, v in zip(by, values, strict=True))
        return os.path.join(root, *parts)

    def begin(at: str, name: str):
        """A file that no listing shows before it is whole."""
        try:
            os.mkdir(at)
        except FileExistsError:
            pass
        except FileNotFoundError:
            os.makedirs(at, exist_ok=True)
        return open(f"{at}/.{name}", "w", encoding="utf-8", newline="\n")

    def finish(out, at: str, name: str) -> None:
        out.close()
        os.replace(f"{at}/.{name}", f"{at}/{name}")

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        # The same name in each attempt of a task: what an earlier one has left is replaced.
        name = f"part-{TaskContext.get().partitionId():05d}-{run}.json"
        held, at, out, objects = None, None, None, 0
        for batch in batches:
            for *values, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if values != held:
                    if out is not None:
                        finish(out, at, name)
                    held, at, objects = values, folder(values), objects + 1
                    out = begin(at, name)
                out.write(line + "\n")
        if out is not None:
            finish(out, at, name)
        yield pa.RecordBatch.from_pydict({"objects": pa.array([objects], pa.int64())})

    return write
