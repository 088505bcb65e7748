"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default the list below).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from querysentry.session import local_session  # noqa: E402
from querysentry.workload import QUERIES  # noqa: E402

HEADLINES = [
    "lexical_features",
    "keyword_count",
    "merge_traces",
    "fill_failed_traces",
    "explode_nodes",
    "tag_counts_expert",
    "tag_counts_mistral",
    "trace_features",
    "statement_features",
    "statement_kind_counts",
    "hybrid_features",
    "named_edges",
    "threshold",
    "predict",
    "basic_metrics",
    "pr_curve",
    "roc_curve",
    "auprc",
    "auroc",
    "recall_by_technique",
    "model_report",
    "standard_scale",
    "score_autoencoder",
    "fit_autoencoder",
    "fit_one_class_svm",
    "nearest_neighbours",
    "score_lof",
    "sample_n",
    "validation_split",
    "overhead_summary",
    "tail_cutoffs",
    "evasion_summary",
    "stream_features",
    "stream_merge_invocations",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINES
    # Start the JVM's and Python workers' code paths once, outside the timings.
    QUERIES["score_table"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
        print(f"{name:32s} {timings[name]:8.3f}", file=sys.stderr, flush=True)
    total = round(sum(timings.values()), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": total, "unit": "sec", "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
