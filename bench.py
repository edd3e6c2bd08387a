"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   folder with the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default: all)
BENCH_QUERIES  comma list of keys, or "all"
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelwise.catalog import QUERIES  # noqa: E402
from panelwise.session import local_session  # noqa: E402

HEADLINE = (
    "wilson_ci collapse_any collapse_any_multi overall_rate freq_1way_pct group_count_pct_within group_pos_rate multi_table_two "
    "univariate_table_one quantiles group_moments swab_time repeat_distribution availability unpivot_wide pivot_long visits_from_wide "
    "presence_summary left_join_visit left_join_baseline semi_join_derived anti_join_ids add_count avg_rank lag_value first_nonnull "
    "first_test_summary incident_tests incident_with_companion baseline_negative_followup always_never initial_vs_later "
    "paired_agreement first_per_id_random duplicate_rows contingency_counts chisq_test fisher_2x2 fisher_rx2 glm_logit glm_log "
    "profile_ci gee_gaussian gee_logit gee_log trend_test predictor_screen"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    chosen = os.environ.get("BENCH_QUERIES", "")
    keys = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus, "bench")
    QUERIES["count_rows"](spark, folder).collect()
    times = {}
    for key in keys:
        start = time.perf_counter()
        QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
