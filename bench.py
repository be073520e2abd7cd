"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from undulate import build_session  # noqa: E402
from undulate.plans import QUERIES, load_all  # noqa: E402

HEADLINE = [
    "synchrony_profile", "robust_z", "rolling_quantile_reflect", "rolling_median_mad", "gaussian_smooth_1d",
    "hysteresis_events", "resample_linear", "event_triggered_average", "pair_corr", "best_lag_corr",
    "coupling_shift_null", "welch_coherence", "run_pca", "encoding_r2", "mann_whitney_effects",
    "random_intercept_slope", "unit_morphology", "core_shell_regions", "overlap_matrix", "similar_pairs_dice",
    "connected_components_26", "voxel_behavior_map",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    load_all()
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["robust_z"](spark, d).write.format("noop").mode("overwrite").save()  # start-up cost is not a query's
    times = {}
    for n in names:
        t = time.time()
        QUERIES[n](spark, d).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
