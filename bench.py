"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from checks import ALL  # noqa: E402
from checks.jobs import SCAN  # noqa: E402
from checks.rules import NOW  # noqa: E402
from checks.views import ARRIVAL, raw_listings  # noqa: E402
from rentweave.operators.merge import merge_listings  # noqa: E402
from rentweave.operators.scoring import score_listing  # noqa: E402
from rentweave.plans.run_scan import run_scan  # noqa: E402
from rentweave.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__driver__memory=os.environ.get("BENCH_MEM", "12g")
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Raw listings are landed once, as a mapper would leave them; the merge queries read that table.
    landed = tempfile.mkdtemp(prefix="rentweave-bench-") + "/raw"
    start = time.time()
    raw_listings(spark, SF_DIR).write.parquet(landed)
    queries = {"land_raw_listings": round(time.time() - start, 3)}
    raw = spark.read.parquet(landed)
    bare = raw.drop("canonical_key", "source_priority", "seen_on_sources")

    jobs = {
        "merge_listings": lambda: merge_listings(raw, ARRIVAL),
        "score_listing": lambda: score_listing(raw, SCAN.dims).select("url", "final", "breakdown"),
        "run_scan": lambda: run_scan(bare, ARRIVAL, SCAN, F.lit(NOW)).outbox,
    }
    for name in ("classify_rental_term", "extract_opengraph", "commute_lookup", "evaluate_filters", "quota_admission", "list_listings"):
        jobs[name] = lambda name=name: ALL[name][0](spark, SF_DIR)
    for name, build in jobs.items():
        spent = []
        for _ in range(RUNS):
            start = time.time()
            run(build())
            spent.append(time.time() - start)
        queries[name] = round(min(spent), 3)
    total = round(sum(queries.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": queries, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
