"""Headline queries, timed; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from parcelwise.session import local_session  # noqa: E402
from workloads import registry  # noqa: E402

HEADLINE = (
    "eal_by_occupancy", "eal_by_tract", "oep_curve", "loss_report", "top_risk",
    "pip_pairs", "pip_exists", "radius_count", "line_distance", "nearest_structure", "nearest_unbounded", "knearest_poi",
    "nearest_perimeters", "radius_capacity", "areal_rollup", "union_cover",
    "source_probe", "composite_confidence", "solar_composite", "solar_v1_score", "discover", "interconnection_cost",
    "wildfire_risk", "flood_risk", "quake_damage", "portfolio_summary",
    "profile_ring", "competitive_gap", "partial_score", "trade_discover", "site_report",
    "training_frame", "auc_gini", "spearman", "stratified_split", "masked_composite", "state_backtest", "flood_backtest",
    "raster_slope", "raster_focal", "raster_sample", "audit_events",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    queries = registry.collect("QUERIES")
    # Each query first runs once, untimed, on the smallest tables, so that no time holds class loading.
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm = small if os.path.isdir(small) else sf_dir
    times: dict[str, float] = {}
    for name in HEADLINE:
        queries[name](spark, warm).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
            }
        )
    )


if __name__ == "__main__":
    main()
