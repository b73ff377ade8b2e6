"""Headline queries timed one by one; prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 4) choose data and cores;
names given as arguments choose other queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "clean_transactions categorize_keywords anomaly_duplicate anomaly_scores insights dashboard_summary "
    "fraud_near_duplicate fraud_amount_anomaly fraud_no_transaction fraud_risk match_scores "
    "match_invoices extract_invoice compliance_summary audit_roundtrip stream_daily_counts"
).split()


def main() -> None:
    from outlay.plans.registry import all_queries
    from outlay.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "4")
    spark = local_session(cores, "outlay-bench")
    spark.sparkContext.setLogLevel("ERROR")
    entries = all_queries()
    # Warm up: the first query should not pay for starting the engine and reading the first file.
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
