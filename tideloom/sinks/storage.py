"""The few file-system calls that are no DataFrame operation: existence and removal."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# Fixed value: how many removals are in flight at once.
PARALLEL_CALLS = 32


class Storage:
    """Paths on whatever file system the session's Hadoop configuration maps them to."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, path: str):
        hadoop_path = self._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self._conf), hadoop_path

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def children(self, path: str) -> list[str]:
        """Names of the entries of a folder, none if it does not exist."""
        fs, at = self._at(path)
        return sorted(entry.getPath().getName() for entry in fs.listStatus(at)) if fs.exists(at) else []

    def local(self, path: str) -> str | None:
        """The path on a local disk; none on any other file system."""
        fs, at = self._at(path)
        return at.toUri().getPath() if fs.getUri().getScheme() == "file" else None

    def entries(self, path: str) -> list[str]:
        """Full paths of the entries of a folder, or of a file itself."""
        fs, at = self._at(path)
        return self._paths(fs.listStatus(at))

    def matching(self, pattern: str) -> list[str]:
        """Full paths of what a glob pattern finds."""
        fs, at = self._at(pattern)
        return self._paths(fs.globStatus(at))

    def _paths(self, statuses) -> list[str]:
        if statuses is None or not len(statuses):
            return []
        # As one text, since a call for each path would take long; no path has a zero in it.
        paths = self._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(statuses)
        return self._jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(paths).mkString("\0").split("\0")

    def modified(self, path: str) -> float:
        """When a file or folder was last changed, in seconds."""
        fs, at = self._at(path)
        return fs.getFileStatus(at).getModificationTime() / 1000

    def create_new(self, path: str) -> bool:
        """Create an empty file; false if it is there already."""
        fs, at = self._at(path)
        try:
            fs.create(at, False).close()
        except Py4JJavaError:
            if fs.exists(at):
                return False
            raise
        return True

    def remove(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.delete(at, True)

    def remove_all(self, paths: Iterable[str]) -> int:
        with ThreadPoolExecutor(PARALLEL_CALLS) as pool:
            return sum(pool.map(self.remove, paths))

    def missing(self, paths: Iterable[str]) -> list[str]:
        paths = list(paths)
        with ThreadPoolExecutor(PARALLEL_CALLS) as pool:
            return [p for p, there in zip(paths, pool.map(self.exists, paths)) if not there]
