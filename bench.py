"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

from veritally.plans import catalog
from veritally.session import get_session

HEADLINE = (
    "threshold_sweep",
    "holdout_threshold",
    "roc_auc",
    "latency_percentiles",
    "judge_report",
    "judge_agreement",
    "privacy_ablation",
    "bucket_table",
    "ragtruth_samples",
    "stratified_sample",
    "describe_dataset",
    "majority_vote",
    "faithfulness_score",
    "align_verdicts",
    "detect_pii",
    "sanitize_requests",
    "merge_overlapping_spans",
    "pii_detection_quality",
    "job_status",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("bench", os.environ.get("BENCH_CPUS", "8"))
    registered = catalog.queries()
    # One small job so that start-up is not charged to the first query.
    registered["coverage"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
