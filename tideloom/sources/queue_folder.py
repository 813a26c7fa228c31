"""A folder of messages as a streaming source: offsets into its files, a cap by messages.

Messages stand in files, one to a line: an object with ``message_id, sent_at, body``, or any
other text, which is a body then. Files are taken in order of their time and name and are not
changed once they are there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .files import BATCH_CAP

FORMAT = "message_folder"
SCHEMA = "message_id string, sent_at timestamp, body string"


def _source():
    """The source's class; made here, so that it travels to the executors by value."""
    import json
    from datetime import datetime, timezone

    from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

    def opened(path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))

    def lines(path: str, name: str, first: int, last: int | None):
        """Lines ``first`` to ``last`` of a file, without reading beyond."""
        system, root = opened(path)
        with system.open_input_stream(f"{root}/{name}") as stream:
            held, number = b"", 0
            while last is None or number < last:
                more = stream.read(1 << 16)
                held += more
                *whole, held = held.split(b"\n")
                if not more and held:
                    whole, held = [*whole, held], b""
                for line in whole:
                    if number >= first and (last is None or number < last):
                        yield line.decode("utf-8", "replace")
                    number += 1
                if not more:
                    return

    def message(line: str) -> tuple:
        try:
            found = json.loads(line)
            sent = datetime.fromisoformat(found["sent_at"])
            sent = sent if sent.tzinfo else sent.replace(tzinfo=timezone.utc)
            body = found["body"]
            return found["message_id"], sent, body if isinstance(body, str) or body is None else json.dumps(body)
        except (ValueError, KeyError, TypeError):
            return None, None, line

    class Stretch(InputPartition):
        def __init__(self, name: str, first: int, last: int | None):
            self.name, self.first, self.last = name, first, last

    class Reader(DataSourceStreamReader):
        def __init__(self, path: str, cap: int):
            self.path, self.cap, self.planned = path, cap, None

        def _files(self, after: dict) -> list[tuple[int, str]]:
            """Files from the offset's own one on, in order; hidden ones are not read."""
            from pyarrow import fs

            system, root = opened(self.path)
            found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
            named = [(f.mtime_ns or 0, f.path[len(root.rstrip("/")) + 1 :]) for f in found if f.is_file and f.base_name[0] not in "._"]
            return sorted(x for x in named if x >= (after["time"], after["file"]))

        def initialOffset(self) -> dict:
            return {"time": -1, "file": "", "line": 0}

        def latestOffset(self) -> dict:
            at, left = self.planned or self.initialOffset(), self.cap
            for time, name in self._files(at):
                first = at["line"] if name == at["file"] else 0
                there = sum(1 for _ in lines(self.path, name, first, first + left))
                if there:
                    at = {"time": time, "file": name, "line": first + there}
                    left -= there
                if not left:
                    break
            return at

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            # Also called for the last batch of an earlier run, which tells a new reader where to go on.
            self.planned = end
            made = []
            for _, name in self._files(start):
                first = start["line"] if name == start["file"] else 0
                if name == end["file"]:
                    made.append(Stretch(name, first, end["line"]))
                    break
                made.append(Stretch(name, first, None))
            return made

        def read(self, partition: Stretch):
            for line in lines(self.path, partition.name, partition.first, partition.last):
                yield message(line)

        def commit(self, end: dict) -> None:
            """Nothing to forget: files stay until their owner removes them."""

    class MessageFolder(DataSource):
        @classmethod
        def name(cls) -> str:
            return FORMAT

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> Reader:
            return Reader(self.options["path"], int(self.options.get("maxMessages", BATCH_CAP)))

    return MessageFolder


def read_messages(spark: SparkSession, path: str, max_messages: int = BATCH_CAP) -> DataFrame:
    """The messages of a folder as a stream of at most ``max_messages`` for each micro-batch.

    Lines of blanks are messages too, with that body. With ``drain_messages(until_empty=True)``
    all there are come in such batches; a stream that is begun again goes on after the last one.
    """
    spark.dataSource.register(_source())
    return spark.readStream.format(FORMAT).option("maxMessages", str(max_messages)).load(path)
