"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default /root/testdata/sf0.1), ``BENCH_CPUS`` the cores.  Every
query runs once to warm up and once for the clock, into a sink that takes all rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from salesloom.session import local_session  # noqa: E402

HEADLINE = [
    "flagship_brand_ranking", "auto_clean_rows", "auto_clean_report", "auto_clean_totals_by_model",
    "interactive_clean_custom", "exact_dedup", "median_fill", "zscore_repair_events", "overview",
    "overview_by_user", "price_histogram", "volume_shares_by_user", "brand_category_pivot",
    "top_rows_per_user", "user_statistics", "upload_list", "linear_fit", "spearman", "counterexamples",
    "regression_metrics", "cross_validation", "cluster_profile", "kmeans_summary", "csv_scan",
]


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        timed(spark, name, sf_dir)
        seconds[name] = round(timed(spark, name, sf_dir), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
