"""Headline queries, timed. Prints one JSON line.

Each query runs to the end into a ``noop`` sink; the time is that of the second run, so it holds no
JVM warm-up; its steps are deleted, within the time. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerline.plans.queries import QUERIES  # noqa: E402
from ledgerline.session import local_session, steps  # noqa: E402

HEADLINES = [
    "criteria_search",
    "search_page",
    "count_by_owner",
    "duplicate_candidates",
    "preview_marking",
    "batch_accept",
    "view_membership",
    "view_counts",
    "pin_fold",
    "bulk_delete",
    "import_ledger",
    "revision_selection",
    "validation_errors",
    "csv_statement_roundtrip",
    "card_monthly_roundtrip",
    "bank_monthly_roundtrip",
    "two_column_roundtrip",
    "text_table_roundtrip",
    "csv_mapping",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINES
    spark = local_session(cpus, shuffle_partitions=8)

    def run(name: str) -> float:
        start = time.perf_counter()
        with steps(spark):
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = run(name)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
