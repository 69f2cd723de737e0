"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Every query is run once
to warm the JVM and then timed as the best of BENCH_RUNS runs into a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from ebbtide.plans import catalog
from ebbtide.session import build_session

HEADLINE = (
    "customer_month", "windowed_usage", "windowed_billing", "latest_txn", "usage_shift", "gold_join", "energy_momentum",
    "daily_energy", "sequence_pad", "crm_clean", "fe_derived", "pid_aggregates", "pid_fallback", "contagion",
    "common_schema_union", "geo_enrich", "hierarchy_fill", "stratified_split", "oof_target", "impute_scale", "roc_auc",
    "threshold_sweep", "tuned_eval", "nearest_rows", "smote", "ensemble_decision", "alert_fatigue", "retention_roi", "what_if",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = tuple(sys.argv[1].split(",")) if len(sys.argv) > 1 else HEADLINE
    spark = build_session(
        "ebbtide-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus),
        extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    entries = catalog.load()
    seconds: dict[str, float] = {}
    for name in wanted:
        best = None
        for attempt in range(runs + 1):
            began = time.perf_counter()
            entries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            if attempt:
                best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    spark.stop()
    name = os.path.basename(folder.rstrip("/"))
    print(json.dumps({
        "metric": "churn_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(name[2:]) if name.startswith("sf") else name,
    }))


if __name__ == "__main__":
    main()
