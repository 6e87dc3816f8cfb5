"""Headline timings: one JSON line on standard output.

Each query runs once to warm up at the smallest scale and once, timed, at ``BENCH_SF_DIR``,
through a sink that consumes every row.
"""

from __future__ import annotations

import json
import os
import sys
import time

from warywire.plans.catalog import QUERIES
from warywire.session import local_session

HEADLINE = (
    "final_features", "final_features_documents", "features_v1", "features_v2", "features_v3", "lexicon_hits",
    "risk_category_by_platform", "validate_messages", "tfidf_vocabulary", "tfidf_weights", "stratified_split",
    "threshold_sweep", "roc_auc", "classification_report", "latency_summary", "explain_linear_score",
    "permutation_importance", "semantic_search", "knn_join", "smote_balance", "interaction_frequency", "pagerank",
    "resumable_ingest", "stream_traffic_stats", "train_logistic", "train_boosted_trees", "score_batch",
    "train_random_forest", "train_gradient_boosting", "explain_tree_paths", "knn_join_cells", "ann_search",
    "tfidf_vocabulary_large", "pagerank_trades", "search_texts", "design_matrix",
)
# A model is trained in the first query that needs it, so these times hold the training; later ones score only.
TRAINING = ("train_logistic", "train_boosted_trees", "train_random_forest", "train_gradient_boosting")


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory=os.environ.get("BENCH_MEMORY", "8g"))
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        if os.path.isdir(warm_dir):
            run(spark, name, warm_dir)
        times[name] = round(run(spark, name, sf_dir), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    line = {"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
            "sf": os.path.basename(sf_dir.rstrip("/")),
            "training_seconds": round(sum(t for n, t in times.items() if n in TRAINING), 3)}
    if "final_features" in times:
        line["messages_per_sec"] = round(events / times["final_features"])
    print(json.dumps(line))


if __name__ == "__main__":
    main()
