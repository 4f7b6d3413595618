"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from driftpool.plans.catalogue import QUERIES  # noqa: E402

HEADLINE = [
    "flagship_balanced_margin", "select_class_balanced", "select_global_margin", "select_random_hash", "select_full_pool",
    "select_least_confidence", "select_entropy", "coreset_greedy", "ranked_batch", "kmeanspp_seed", "candidate_audit",
    "stratified_hash_pools", "membership_summary", "table_digest", "masked_normalizer", "masked_zscore", "embedding_zero_filled",
    "held_out_normalizer", "ridge_scores", "lda_posterior", "oof_calibration", "fixed_test_metrics", "hierarchical_means",
    "compute_cost_quartiles", "label_efficiency", "seed_population_quantiles", "drift_slope", "signed_rank_exact", "holm_adjusted",
    "bootstrap_percentile", "mc_convergence", "compare_selections", "join_cardinality", "trajectory_loop",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("driftpool-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("orders", "embeddings", "lineitem"):  # warm the JVM and the file cache
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
