"""Registered queries against their SQL oracles on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from gridpanel.queries import load_all

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables not present")

# One query per family here; all of them are compared at a larger scale by tools/check.py.
NAMES = [
    "s4_flagged_table", "s10_raster_table", "p2_compose_class", "p8_filter_cells", "j3_full_outer_fold", "j5_fan_out", "j10_nearest_vintage",
    "j12_distance_band", "j14_class_pairs", "a4_weighted_moments", "a11_circular", "a20_group_coverage", "a25_organic_shares", "a30_admin_panel",
    "w7_quantile_bins", "w8_grid_bins", "n1_focal_mean", "n1_focal_complete_wide", "n2_window_median", "n7_morans_i", "t3_split_blocks", "t4_spatial_split",
    "r1_carve_flag", "r2_carve_sequential", "r4_split_by_observed", "r5_class_rules", "r6_rake_to_targets", "r8_resolve_share", "m1_recipe_replay",
    "m10_identifiability_mask", "m13_separation_screen", "q4_posterior_predictive", "q8_predict_nested", "q11_score_trees", "q12_project_step",
    "g1_summarise_draws", "g5_ess_bulk", "g8_contrasts", "g11_decompose", "e1_share_fit", "e6_substitution", "e11_waic", "k3_partial_pooling_slopes",
    "z1_stream_running_stats",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    return con


def norm(v):
    return ("nan" if v != v else repr(v + 0.0)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, db, name):
    q = load_all()[name]
    df = q.run(spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = db.execute(q.oracle())
    pos = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(pos) == cols
    assert got == sorted(tuple(norm(r[pos[c]]) for c in cols) for r in cur.fetchall())
    assert got


def test_entry_and_registry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
