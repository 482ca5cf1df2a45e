"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Every query runs twice and the
second run counts, so that planning and compiling warm code is not measured.
"""

from __future__ import annotations

import json
import os
import time

from tidemark.plans import load
from tidemark.plans.checked import QUERIES
from tidemark.session import build_session

HEADLINE = (
    "guarded_fold_rows",
    "guarded_fold_counts",
    "guarded_fold_over_stored_rows",
    "guarded_fold_hot_key",
    "plain_fold_rows",
    "accept_flags_hot_key",
    "change_feed_mutations",
    "change_feed_applied",
    "notice_mutations",
    "compound_addresses",
    "snapshot_upsert_column_guard",
    "upsert_routes",
    "route_transitions",
    "dashboard_counts",
    "catalogue_page_label_asc",
    "coerce_decimals",
    "coerce_datetimes",
    "cascade_deletes",
    "storage_addresses",
    "file_batches",
    "upload_progress",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load()
    spark = build_session("tidemark-bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    times = {}
    for name in HEADLINE:
        run(spark, name, sf_dir)
        times[name] = round(run(spark, name, sf_dir), 3)
    result = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
