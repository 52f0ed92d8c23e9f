"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the cores. Each query runs once to warm up and is then timed; the
result is written to Spark's no-op sink so every row and column is produced.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardlight.plans.catalog import QUERIES  # noqa: E402
from wardlight.session import build_session  # noqa: E402

HEADLINE = [
    "m25_alert_summary", "w1_lag_features", "w2_rolling_prior_stats", "w3_contextual_head",
    "w4_last_four_visits", "w5_cusum_drift", "w6_adaptive_window_drift", "w11_visit_intervals",
    "w12_duplicate_measurements", "m19_point_head", "d1_d6_model_metrics", "d8_calibrated_threshold",
    "d9_agreement_summary", "d12_daily_trend", "m23_conformal_p_values", "m13_m15_scaled_fusion",
    "r1_r6_clinical_risk", "r7_d23_range_findings", "i12_composite_features", "a15_lab_text_fields",
    "b16_quality_rules", "c8_latest_metric", "c8_wide_encounters", "i9_split_sizes",
    "i1_i6_scaled_features", "m1_isolation_forest", "m12_pca_reconstruction", "x1_ablation",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("wardlight-bench", cpus, "16g")
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        for attempt in ("warm", "timed"):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - started
            if attempt == "timed":
                times[name] = round(spent, 3)
        spark.catalog.clearCache()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
