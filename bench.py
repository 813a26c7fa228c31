"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tideloom.queries import all_queries  # noqa: E402
from tideloom.workspace import session  # noqa: E402

HEADLINE = (
    "latest_event_per_user",
    "precombine_global",
    "precombine_local",
    "upsert_commit_global",
    "upsert_event_global",
    "upsert_commit_local",
    "upsert_event_local",
    "composite_key_upsert",
    "delete_keys",
    "insert_overwrite",
    "insert_if_absent",
    "table_upsert_commit_global",
    "table_upsert_event_global",
    "table_upsert_event_local",
    "table_delete_keys",
    "table_bulk_insert",
    "mor_snapshot",
    "mor_compacted",
    "compact_small_files",
    "expire_versions",
    "expand_notifications",
    "quarantine_split",
    "ingest_run",
    "stream_drain",
    "resolve_runs",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    # A cluster session names the folder its executors share; this one does so too.
    shared = {"spark.checkpoint.dir": os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="tideloom-bench-")}
    spark = session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", **shared},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()  # start-up is not timed
    times = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
