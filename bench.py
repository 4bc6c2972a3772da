"""Headline queries, timed one by one on ``$BENCH_SF_DIR``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "transition_profile", "stage_macro_architecture", "fragmentation", "bout_statistics", "event_indices", "respiratory_summary",
    "oxygenation_odi_burden", "post_event_recovery", "hrv_time_domain", "hrv_dfa_alpha1", "epoch_band_powers", "spectral_shape",
    "spindle_events", "connectivity", "time_delay_stability", "numeric_summary_lineitem", "incident_labels", "prevalence_reward",
    "auroc_age_conditioned", "harrell_c_index", "mann_whitney", "site_rank", "combat", "bootstrap_auroc", "knn_join", "loso_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from hypnolake.plans import QUERIES
    from hypnolake.session import build_session, drop_written

    shared = tempfile.mkdtemp(prefix="hypnolake-bench-")
    spark = build_session(
        f"local[{cpus}]", "hypnolake-bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.checkpoint.dir": shared},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # session warm-up
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        drop_written(spark)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
