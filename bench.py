"""Time the headline queries at $BENCH_SF_DIR and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from corpuskit.session import local_session
from corpuskit.workload import load

HEADLINE = [
    "dense_topk_cosine", "dense_per_collection", "bm25_topk", "hybrid_topk", "multi_query_topk", "bm25_fill",
    "mmr_topk", "ranking_metrics", "embedding_duplicates", "clean_default_order", "chunk_fixed",
    "chunk_recursive", "chunk_heading_aware", "chunk_findings", "exact_duplicates", "select_context",
    "budget_enforce", "render_prompts", "embed_distinct", "latest_version", "report_page", "trace_latency",
    "session_stats",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, app="corpuskit-bench", memory="16g", shuffle_partitions=int(cores))
    queries, _ = load()
    spark.read.parquet(f"{folder}/documents.parquet").count()  # start the executors
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
