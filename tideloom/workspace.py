"""Where working data goes, and the session the jobs expect."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the session.

    Only a local session may fall back to a folder of this machine.
    """
    global _local_root
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="tideloom-")
    return _local_root


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


_SETTING_LOCK = threading.RLock()  # writes of one session take turns where they need another setting


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Another value of a session's setting for as long as it takes."""
    with _SETTING_LOCK:
        before = spark.conf.get(key, None)
        spark.conf.set(key, value)
        try:
            yield
        finally:
            if before is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, before)


def session(name: str = "tideloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on, zone-less behaviour pinned to UTC."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
