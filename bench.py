"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line of seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

from floorledger.plans import registry
from floorledger.session import build_session

HEADLINE = [
    "AGG-1_by_link", "WIN-1_superseded", "SRC-13_change_rows", "SRC-14_ingest", "JOIN-17_catalog_price", "AGG-3_options_total", "JOIN-25_resolve_finish", "JOIN-18_tenant_filter",
    "VER-1_replay_saves", "WIN-13_newest_versions", "FN-4_parse_dims", "FN-8_normalise_name", "FN-11_classify_room", "GEO-1_2_area_centroid", "GEO-6_wall_pieces", "JOIN-2_smallest_face", "JOIN-3_nearest_wall",
    "JOIN-4_openings_overlap", "JOIN-5_DQ-4_walls_intersect", "JOIN-8_pair_walls", "JOIN-27_in_box", "WIN-6_sessions", "WIN-9_filled_floors", "WIN-10_floor_runs", "WIN-12_merge_collinear",
    "SET-4_tower", "AGG-4_monthly_wind", "AGG-6_scoreboard", "AGG-7_confusion", "AGG-14_otsu", "AGG-16_ratio_consensus", "FN-18_sun_position", "GRF-4_components", "GRF-1_faces",
]


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = build_session("bench", cpus, max(8, int(cpus)) if cpus.isdigit() else 8)
    qs = registry.load()
    qs["AGG-1_by_link"].run(spark, base).limit(1).collect()  # start the engine
    seconds = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        t = time.time()
        qs[name].run(spark, base).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - t, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(base.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
