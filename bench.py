"""Seconds of the headline queries, as one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fixtrace.plans import catalog  # noqa: E402
from fixtrace.session import build_session  # noqa: E402

HEADLINES = [
    "tfidf_similarity", "retrieval_hit_rate", "ranking_metrics_zero_based", "ranking_metrics_first_hit_effort",
    "rank_within", "rank_within_sliced", "top_k", "grid_search_weight", "hybrid_retrieve", "nearest_history", "greedy_match", "mean_pool",
    "unified_zero", "minimal_diff", "minimise_patch", "file_code", "weighted_group_split", "train_test_validation",
    "sample_negatives", "assemble_pairs", "lines_in_functions", "call_context", "code_search", "roc_auc",
    "classification_report", "advisory_report", "stream_ttl_dedupe",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(f"local[{cores}]", "bench", **{
        "spark.sql.shuffle.partitions": cores, "spark.checkpoint.dir": tempfile.mkdtemp(prefix="fixtrace-bench-"), "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINES:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
        print(name, [round(r, 2) for r in runs], file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "sum of headline query seconds, better of two runs each", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
