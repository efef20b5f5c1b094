"""Benchmark of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (8).
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.registry import QUERIES  # noqa: E402
from postmill.session import local_session, use_scratch  # noqa: E402

HEADLINE = [
    "normalize_posting_url", "fingerprints", "page_text", "classify_keywords", "classify_documents",
    "label_counts", "route_cards", "dedupe_batch", "containment_pairs", "select_new", "insert_ignore",
    "read_greenhouse", "read_markdown", "read_html", "align_scores",
    "source_counts", "major_counts", "stats_json", "apply_retry", "daily_run",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = use_scratch(local_session(cores, shuffle_partitions=int(cores)), tempfile.mkdtemp(prefix="postmill-bench-"))
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm_dir):
        for name in HEADLINE:
            run(spark, name, warm_dir)
    seconds = {name: run(spark, name, sf_dir) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
