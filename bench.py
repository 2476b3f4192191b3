"""Headline-query benchmark: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set
the input and the local parallelism.  Each query is executed to completion
with the no-op sink (full plan, no driver collect); the value is the sum of
the per-query wall-clock seconds.  Every query runs once on the smallest
tables first (BENCH_WARM_DIR) so the timings are steady-state.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "H1_J10_F8_F9_P9_health_snapshot",
    "H5_J7_A16_A17_A18_T6_T7_F25_fleet_overview",
    "M1_W1_W2_W3_F5_F6_feature_table",
    "R2_incremental_features",
    "J1_P13_H6_overlay_nearest",
    "W7_counter_rate",
    "A5_A6_T3_ssh_stats",
    "A7_T5_F19_attackers_top20",
    "H3_F17_threat_summary",
    "F1_H2_T1_ssh_events_last200",
    "H4_F10_F20_J2_J3_rule_report",
    "T1_log_history_200",
    "S1_S2_parse_metric_json",
    "F4_F24_document_line_severity",
    "A14_scores_dedup",
    "M3_F22_iforest_scores",
    "R3_R4_alert_replay",
    "R5_online_hst_scores",
]


def main() -> None:
    from fleetscope.plans import catalog
    from fleetscope.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", max(cpus, 8),
                          extra={"spark.ui.showConsoleProgress": "false",
                                 "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    qs = catalog.queries()
    names = [n for n in HEADLINE if n in qs]
    if os.environ.get("BENCH_ALL"):
        names = list(qs)
    # warm-up on the smallest tables: JIT, generated code, Python workers;
    # the timed runs then measure steady state at the requested scale
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for n in names:
            qs[n](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.perf_counter()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
