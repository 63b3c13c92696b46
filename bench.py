"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]

Every query is computed in full and thrown away, once to warm up and then once, or three times if that takes less than
WARM_S; the median of those after the first counts. Tables that several queries start from are staged
first and timed on their own (``stage_*``), so a query's time is the time of its own work.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

WARM_S = 6.0

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "zone_hits", "rule_hits", "zone_ids_per_detection", "class_summary", "motion", "track_by_overlap", "throttle",
    "dwell_sessions", "dwell_sessions_reattached", "crowd_sessions", "heartbeat_events", "occupancy", "alert_sessions",
    "plan_snapshots", "frames_around", "plan_clips", "frame_for_event", "upsert_ai_events", "sensor_active", "correlate",
    "risk_levels", "dedup_events", "liveness", "camera_metrics", "performance", "event_rollup", "match_ground_truth",
    "scope_evidence", "effective_access", "check_integrity",
]
STAGES = ["hits", "stays", "crowds", "beats", "linked", "snapshots"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from zonewatch.session import build_session

    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=str(2 * int(cpus)), spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    import catalog

    catalog.load()
    views = lambda: catalog.Views(spark, folder)
    spark.range(10).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    names = sys.argv[1:] or HEADLINE
    for name in STAGES:
        t = time.time()
        getattr(views(), name)
        times[f"stage_{name}"] = round(time.time() - t, 3)
    for name in names:
        runs: list[float] = []
        # The first run warms up; of the others, one or three, the median counts.
        while len(runs) < 2 or (len(runs) < 4 and runs[1] < WARM_S):
            t = time.time()
            catalog.QUERIES[name](views()).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
        times[name] = round(median(runs[1:]), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    detections = views().detections.count()
    hits = times.get("zone_hits")
    print(json.dumps({
        "metric": "headline query time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": int(cpus), "detections": detections,
        "zone_test_detections_per_s_per_core": round(detections / hits / int(cpus)) if hits else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
