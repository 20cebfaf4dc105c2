"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and BENCH_QUERIES (comma-separated names, or 'all')
steer the run. Every query runs to its full result into Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tastelake.plans.registry import load_all, run
from tastelake.session import local_session

HEADLINE = (
    "trending_topk search_filtered list_page user_summary genre_preference rating_histogram recent_items rating_upsert "
    "item_neighbors_cosine content_neighbors_tfidf hybrid_similar user_scores_top50 hybrid_user_recs recommend_cards "
    "late_fusion bought_together item_cf bias_baseline markov_next ranking_report list_diversity gini_exposure ab_readout "
    "ctr_conversion sessions latency_percentiles alert_runs quality_report psi_drift bm25 tumbling_trending communities"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(load_all()) if asked == "all" else (asked.split(",") if asked else HEADLINE)
    spark = local_session(cpus, shuffle_partitions=2 * int(cpus) if cpus.isdigit() else 16, name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        try:
            run(name, spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        except Exception as problem:  # noqa: BLE001 - one broken query must not hide the others
            times[name] = None
            print(f"{name}: {type(problem).__name__}: {str(problem)[:300]}", file=sys.stderr)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(t for t in times.values() if t is not None), 3)
    print(json.dumps({"metric": "total wall time of headline queries", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
