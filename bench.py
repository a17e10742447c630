"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from gridpanel.queries import load_all  # noqa: E402
from gridpanel.session import configure  # noqa: E402

# One query per family of the inventory, the heavy ones first of their kind.
HEADLINE = [
    "flagship_nation_diversity", "s4_flagged_table", "s10_raster_table", "p1_map_classes", "p8_filter_cells", "j5_fan_out", "j9_latest_before",
    "j11_lattice_range_join", "j12_distance_band", "a4_weighted_moments", "a12_category_shares", "a30_admin_panel", "w4_group_share",
    "w7_quantile_bins", "n1_focal_complete_wide", "n2_window_exponential", "n7_morans_i", "t4_spatial_split", "r2_carve_sequential",
    "r5_class_rules", "r6_rake_to_targets", "m1_recipe_replay", "m8_group_support", "m13_separation_screen", "m14_pair_moments",
    "q3_predict_mean", "q4_posterior_predictive", "q8_predict_nested", "q11_score_trees", "q12_project_step", "g1_summarise_draws", "g4_rhat",
    "g5_ess_bulk", "g8_contrasts", "e1_share_fit", "e5_calibration", "k1_coefficients", "k3_partial_pooling_means",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    registry = load_all()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    times = {}
    for name in names:
        start = time.perf_counter()
        # every column is computed and counted without sending rows to the driver
        df = registry[name].run(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(sf.group(1)) if sf else None,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
