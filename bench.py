"""Headline-query benchmark: median of 3 runs after one warm-up.

Prints ONE JSON line. Each query is forced to completion with the no-op
sink (full evaluation, nothing collected to the driver).
env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kestrel.plans.registry import QUERIES  # noqa: E402
from kestrel.session import get_session  # noqa: E402

HEADLINE = ["groupby_agg", "group_distribution", "cohort_long", "timeseries_monthly_gapfill", "kpi_by_segment",
            "star_groupby", "column_profile", "quality_report", "welch_t_by_segment", "mann_whitney",
            "ols_coefficients", "driver_suite"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(2 * cpus, 8),
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    times = {}
    for name in HEADLINE:
        fn = QUERIES[name]

        def run():
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        run()
        times[name] = round(statistics.median(run() for _ in range(reps)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
