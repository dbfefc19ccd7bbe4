"""Time the headline queries and print one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS] (default 8). Every query is written to the noop
sink, so all rows are computed and none are collected. $BENCH_KEYS limits the run to some queries.
"""

from __future__ import annotations

import json
import os
import time

from basketry.plans import registry
from basketry.runtime import local_session

HEADLINE = [
    "next_week_top10",
    "time_based_split",
    "item_popularity",
    "user_activity",
    "item_catalog_orders",
    "count_distribution",
    "time_gaps",
    "temporal_pairs",
    "tifu_vectors",
    "user_knn",
    "tifu_scores",
    "item_gram",
    "item_ridge",
    "item_ridge_scores",
    "als_recommend",
    "embedding_topn",
    "profile_knn",
    "rrf",
    "fusion_sweep",
    "evaluate_slices",
    "candidate_features",
    "rerank_binary",
    "rerank_pairwise",
    "user_profile",
    "content_candidates",
    "carousel",
    "evidence_pack",
    "hard_gate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = os.environ.get("BENCH_KEYS", "").split() or HEADLINE
    registry.load_all()
    spark = local_session("bench", cpus)
    # Start the JVM's code paths and Python workers before anything is timed.
    registry.QUERIES["rrf"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    seconds = {}
    for key in keys:
        started = time.perf_counter()
        registry.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
