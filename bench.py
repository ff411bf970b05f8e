"""Headline queries on one machine: BENCH_SF_DIR (default sf0.1), local[BENCH_CPUS]. Prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from winback.session import get_session

HEADLINE = [
    "customer_summary_build", "rfm", "feature_matrix", "window_count", "purchase_cycle", "session_features", "recent_sequence", "activity_snapshots",
    "state_at_asof", "future_label", "churn_proxy_score", "action_candidates", "candidate_pool", "greedy_budget", "segment_allocation", "budget_sensitivity",
    "baseline_engine", "cf_scenarios", "cf_best_action", "cohort_all", "cohort_summary", "churn_top_patterns", "journey_funnel", "recommend_topk", "explain_rules",
    "qini_curve", "threshold_by_value", "kaplan_meier", "concordance_index", "decayed_signals", "reopt_trigger", "live_actions", "event_standardise", "data_diagnostics",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", "winback-bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
        "spark.checkpoint.dir": os.environ.get("BENCH_SHARED_DIR", tempfile.mkdtemp(prefix="winback-bench-"))})
    spark.sparkContext.setLogLevel("ERROR")
    from winback.registry import QUERIES
    times: dict[str, float] = {}
    for name in HEADLINE:
        t = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
