"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "rate_baseline",
    "profile",
    "sparse_counts",
    "rate_stats",
    "causal_rates",
    "daily_decay",
    "momentum",
    "histories",
    "list_quantile",
    "rate_fields",
    "recency_columns",
    "item_cooccurrence",
    "item_cf_scores",
    "bpr_pairs",
    "listwise_loss",
    "ranking_metrics",
    "paired_bootstrap",
    "temporal_halves",
    "spearman",
    "rank_average",
    "blend_sweep_grid",
    "compare_all",
    "best_node",
    "debug_depth",
    "near_top",
    "billed_no_improve_streak",
    "untried_patches",
    "screen_gate",
    "similar_errors",
    "graveyard",
    "read_ledger",
    "stream_user_counts",
    "base_fields",
    "recency_fields",
    "encode_all",
    "spearman_filter",
    "complementary_blend",
    "pick_final",
    "fm_ranker",
    "gbt_ranker",
]


def main() -> None:
    from rankspark.plans.catalog import QUERIES
    from rankspark.session import build_session, drop_cuts

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("rate_baseline", "best_node"):  # start the JVM paths once, unmeasured
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        drop_cuts(spark)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
