"""Time the headline queries and print one JSON line.

Each query runs in full (its result is written to the no-op sink); the reported time
is the best of BENCH_REPEAT runs, so that one-off start-up is not counted.
"""

from __future__ import annotations

import json
import os
import time

from emberline.plans.catalog import CATALOG
from emberline.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEAT = int(os.environ.get("BENCH_REPEAT", "2"))
HEADLINE = [
    "exposure_by_class", "exposure_100m", "exposure_500m_known_cells", "exposure_wind_slope", "interface_both", "curvature",
    "null_components", "gap_fill", "directional_transects", "rasterize_squares", "align_average_coarser", "fuel_merge",
    "danger_index_product", "risk_equal_mean", "risk_pareto_front", "percentile_by_cell", "percentile_by_zone", "fwi_series",
    "zone_table", "downscaled_weather", "auc_against_burnt", "profile_quartiles", "hourly_to_daily", "dnbr_cells",
    "stream_station_codes",
]


def main() -> None:
    spark = local_session(CPUS)
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    times = {}
    for name in only or HEADLINE:
        best = None
        for _ in range(REPEAT):
            start = time.perf_counter()
            CATALOG[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
