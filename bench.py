"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3, the median counts), BENCH_QUERIES (names, comma separated).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from skytable.fixtures import table
from skytable.plans import all_queries
from skytable.session import local_session

HEADLINE = (
    "flagship_request_scenes", "joi6_search_scenes", "win2_mosaic_first", "joi11_rasterize", "win6_nms",
    "joi12_box_iou_pairs", "ras18_connected_components", "geo15_footprints", "agg1_collection_summary",
    "agg3_upper_median", "agg13_stretch", "joi1_attach_links", "joi3_complete_granules", "joi13_cover_tiles",
    "fil7_filter_features", "geo9_clip_features", "lif1_apply_transition", "agg15_best_so_far",
)


def run_once(spark, build, sf_dir: str) -> float:
    start = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def calibration(spark, sf_dir: str) -> float:
    """Seconds of a plain scan and hash aggregate, by which runs on different machines can be compared."""

    def plain(spark, sf_dir):
        lines = table(spark, sf_dir, "lineitem")
        return lines.groupBy("l_partkey", "l_returnflag").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))

    return statistics.median(run_once(spark, plain, sf_dir) for _ in range(5))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    run_once(spark, all_queries.QUERIES["agg1_collection_summary"], sf_dir)
    before = calibration(spark, sf_dir)
    seconds = {
        name: round(statistics.median(run_once(spark, all_queries.QUERIES[name], sf_dir) for _ in range(runs)), 3)
        for name in names
    }
    plain = (before + calibration(spark, sf_dir)) / 2
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
             "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "calibration": round(plain, 3),
             "ratios": {name: round(value / plain, 1) for name, value in seconds.items()}}
        )
    )


if __name__ == "__main__":
    main()
