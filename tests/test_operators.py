"""Invariants and hand-checked cases of the operators."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridpanel.functions import scalar
from gridpanel.operators import aggregate as ag
from gridpanel.operators import allocate as al
from gridpanel.operators import classes as cl
from gridpanel.operators import design as de
from gridpanel.operators import draws as dr
from gridpanel.operators import drawstore as ds
from gridpanel.operators import estimate as es
from gridpanel.operators import focal as fo
from gridpanel.operators import joins as jn
from gridpanel.operators import metrics as me
from gridpanel.operators import nested as ne
from gridpanel.operators import score as so
from gridpanel.operators import screens as sc
from gridpanel.operators import split as sp
from gridpanel.operators import windows as wn
from gridpanel.queries.base import Tables
from gridpanel.plans.skew import average_ranks, hash_order


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ---- classes ---------------------------------------------------------------------------------------------------


def test_unmapped_positive_area_fails(spark):
    df = spark.createDataFrame([(1, 10, 2.0), (1, 99, 0.0)], "cell int, code int, area double")
    lookup = spark.createDataFrame([(10, "A")], "code int, class string")
    assert cl.map_classes(df, lookup, "code", "class").count() == 2
    bad = df.unionByName(spark.createDataFrame([(2, 98, 1.0)], df.schema))
    with pytest.raises(PySparkException, match="unmapped code"):
        cl.map_classes(bad, lookup, "code", "class").collect()


def test_compose_and_suffix(spark):
    df = spark.createDataFrame([("Cropland", "HI", "organic wheat"), (" ", None, "x"), ("1 odd", "", "irrigated")], "a string, b string, label string")
    out = cl.compose_class(df, ["a", "b"])
    assert [r["model_class"] for r in out.collect()] == ["Cropland_HI", "NODATA", "X1.odd"]
    assert [r["model_class"] for r in cl.suffix_classes(out, "label").collect()] == ["Cropland_HI_O", "NODATA", "X1.odd_IR"]
    bad = spark.createDataFrame([("organic", "NODATA")], "label string, model_class string")
    with pytest.raises(PySparkException):
        cl.suffix_classes(bad, "label").collect()


def test_class_set_change_is_order_sensitive():
    assert cl.class_set_change(["a", "b", "c"], ["b"], ["d", "a"]) == ["a", "c", "d"]


# ---- aggregates and joins --------------------------------------------------------------------------------------


def test_weighted_sd_edge_cases(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 1.0), ("b", 3.0, 1.0), ("b", float("nan"), 1.0), ("b", 9.0, 0.0)], "k string, x double, w double")
    got = dict(rows(df.groupBy("k").agg(ag.weighted_sd(F.col("x"), F.col("w")).alias("s")), "k", "s"))
    assert got == {"a": 0.0, "b": 1.0}


def test_checks_raise(spark):
    a = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, area double")
    with pytest.raises(ag.ConservationError):
        ag.assert_conserved(a, a.limit(1), "area")
    with pytest.raises(ValueError):
        ag.assert_unique(a, ["k"])
    with pytest.raises(ValueError):
        ag.assert_shares(a, ["k"], "area")


def test_crosswalk_gate(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    xw = spark.range(5).select(F.col("id").alias("a"), (F.col("id") + 100).alias("b"))
    with pytest.raises(ValueError, match="50.0%"):
        jn.crosswalk_join(df, xw, "k", "a", "b")
    assert jn.crosswalk_join(df, xw, "k", "a", "b", min_kept=0.5).count() == 5


def test_lag_zero_is_refused(spark):
    with pytest.raises(ValueError):
        wn.lagged_state(spark.range(1), ["id"], "id", ["id"], 0)


def test_autocovariance_over_block_borders(spark):
    x = np.random.default_rng(0).normal(size=100)
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(1, 101), "v": x}))
    got = {r["lag"]: r["acov"] for r in wn.autocovariance(df, [], "t", "v", 6, block=10).collect()}
    d = x - x.mean()
    assert all(math.isclose(got[k], float(d[: 100 - k] @ d[k:]) / 100, rel_tol=1e-9, abs_tol=1e-12) for k in range(7))


def test_autocovariance_in_lag_ranges(spark):
    rng = np.random.default_rng(4)
    x = {k: np.cumsum(rng.normal(size=n)) for k, n in (("hot", 700), (None, 90), ("one", 1))}
    df = spark.createDataFrame([(k, 3 * i + 5, float(v)) for k, part in x.items() for i, v in enumerate(part)], "k string, t int, v double")
    series = wn.centred_series(df, ["k"], "t", "v", sparse=True)
    for low, high in ((0, 16), (16, 48), (48, 640), (640, 900)):
        got = {(r["k"], r["lag"]): r["acov"] for r in wn.lag_sums(series, ["k"], low, high, block=20).collect()}
        for k, part in x.items():
            d, n = part - part.mean(), len(part)
            for lag in range(low, high):
                want = float(d[: n - lag] @ d[lag:]) / n if lag < n else 0.0
                assert math.isclose(got.get((k, lag), 0.0), want, rel_tol=1e-8, abs_tol=1e-9)


# ---- as-of and spacing -----------------------------------------------------------------------------------------


def test_as_of_over_range_borders(spark):
    rng = np.random.default_rng(9)
    keys = ["hot"] * 60 + [None] * 5 + list("ab") * 10
    left = [(k, None if i % 17 == 0 else int(rng.integers(0, 400)), i) for i, k in enumerate(keys * 2)]
    right = [(k, None if i % 23 == 0 else 3 * i % 301, float(i)) for i, k in enumerate(keys) if k != "b"]
    ldf, rdf = spark.createDataFrame(left, "k string, at int, id int"), spark.createDataFrame(right, "k string, w int, v double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        last = {r["id"]: (r["matched_w"], r["v"]) for r in jn.latest_before(ldf, rdf, ["k"], "at", "w", ["v"]).collect()}
        near = {r["id"]: (r["matched_w"], r["v"]) for r in jn.nearest_vintage(ldf, rdf, ["k"], "at", "w", ["v"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(last) == len(near) == len(left)
    for k, at, i in left:
        known = [(w, v) for g, w, v in right if g == k and k is not None and w is not None and at is not None]
        past = [e for e in known if e[0] <= at]
        assert last[i] == (max(past) if past else (None, None))
        nearest = min(known, key=lambda e: (abs(e[0] - at), e[0], -e[1])) if known else (None, None)
        assert near[i] == nearest


def test_grid_spacing_across_ranges(spark):
    pts = spark.createDataFrame([(float(i * 10), float(i * 40) if i != 7 else 273.0) for i in range(40)] + [(None, 5000.0)], "x double, y double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert fo.infer_resolution(pts, ["y"]).first()["res"] == 33.0
        assert fo.infer_resolution(pts, ["x", "y"]).first()["res"] == 10.0
        assert fo.infer_resolution(pts.limit(1), ["x"]).first()["res"] is None
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# ---- lattice ---------------------------------------------------------------------------------------------------


def test_focal_crosses_tile_borders(spark):
    side = fo.TILE + 6
    pdf = pd.DataFrame([(i, j, "A" if (i * j) % 3 else "B", 1.0 + (i + 2 * j) % 4) for i in range(-3, side) for j in range(3)], columns=["ix", "iy", "class", "area"])
    got = {(r["ix"], r["iy"], r["class"]): (r["focal"], r["n_neighbours"]) for r in fo.focal_mean(spark.createDataFrame(pdf), [], "ix", "iy", "class", "area", False).collect()}
    cls = {(r.ix, r.iy): r["class"] for _, r in pdf.iterrows()}
    for (i, j), _ in cls.items():
        near = [cls[(i + a, j + b)] for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0) and (i + a, j + b) in cls]
        for c in set(near):
            f, n = got[(i, j, c)]
            assert n == len(near) and math.isclose(f, near.count(c) / len(near))


def test_uniform_neighbourhood_and_nodata(spark):
    cells = spark.createDataFrame([(i, j, 2.0, 0.0) for i in range(4) for j in range(4)], "ix int, iy int, A double, B double")
    out = {(r["ix"], r["iy"]): (r["focal_A"], r["focal_NODATA"]) for r in fo.focal_columns(cells, [], "ix", "iy", ["A", "B"], nodata=True).collect()}
    assert out[(1, 1)] == (1.0, 0.0) and out[(0, 0)] == (0.0, 1.0)


def test_window_mean_is_attenuated_at_the_border(spark):
    df = spark.createDataFrame([(i, j, 8.0) for i in range(3) for j in range(3)], "ix int, iy int, v double")
    got = {(r[0], r[1]): r[2] for r in fo.focal_window(df, [], "ix", "iy", "v", fo.window_weights(3)).collect()}
    assert got[(1, 1)] == 8.0 and got[(0, 0)] == 3.0
    with pytest.raises(ValueError):
        fo.window_weights(4)


def test_split_roles_are_disjoint_and_keep_groups(spark):
    pts = spark.range(4000).select("id", (F.col("id") % 80).alias("ix"), F.floor(F.col("id") / 80).alias("iy"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"))
    out = sp.spatial_split(pts, ["id"], "ix", "iy", "g", 0.2, side=10).toPandas()
    assert len(out) == 4000 and out["id"].is_unique
    assert set(out["g"]) == set(out.loc[out["role"] == "train", "g"])
    block = {(r.ix, r.iy) for r in out[out["role"] == "test_block"].itertuples()}
    assert block
    for r in out[out["role"].isin(["train", "test_random"])].itertuples():
        assert not any((r.ix + a, r.iy + b) in block for a in (-1, 0, 1) for b in (-1, 0, 1))


def test_morans_i_detects_a_gradient(spark):
    df = spark.createDataFrame([(float(i), float(j), float(i)) for i in range(8) for j in range(8)], "x double, y double, v double")
    r = fo.morans_i(df, "x", "y", "v", 1.0).first()
    assert r["moran_i"] > 0.7 and r["p_value"] < 1e-6 and r["n_isolated"] == 0


# ---- allocation ------------------------------------------------------------------------------------------------

RULES = [
    {"action": "rename", "from": "meadow", "to": "grass"},
    {"action": "split", "from": "arable", "to": "field"},
    {"action": "split", "from": "cereal", "to": "grain"},
    {"action": "rename", "from": "nowhere", "to": "grass"},
]
SHARES = [
    ("field", "QX10", "cereal", 0.25), ("field", "QX10", "roots", 0.75), ("field", "QY", "cereal", 1.0),
    ("grain", "QX", "oats", 0.6), ("grain", "QX", "rye", 0.4),
]


def _ruled(spark, shares, rules=RULES):
    cells = spark.createDataFrame([(i, c, 4.0) for i in range(3) for c in ("meadow", "arable", "water")], "cell int, class string, area double")
    geo = spark.createDataFrame([(0, "QX10"), (1, "QY77"), (2, None)], "cell int, geo string")
    table = spark.createDataFrame(shares, "group string, geo string, target string, share double")
    return cells, al.apply_class_rules(cells, rules, table, geo, "cell", "class", "area")


def test_rule_cascade(spark):
    """Exact, prefix and unknown regions; the result of a split is split again."""
    cells, out = _ruled(spark, SHARES)
    ag.assert_conserved(cells, out, "area", ["cell"])
    got = {(r["cell"], r["class"]): round(r["area"], 9) for r in out.collect()}
    assert got[(0, "roots")] == 3.0 and got[(0, "oats")] == 0.6 and got[(0, "grass")] == 4.0
    assert got[(1, "oats")] == 2.4 and (1, "roots") not in got
    # mean shares of the group by target: cereal 0.625, roots 0.75; renormalised
    assert got[(2, "roots")] == pytest.approx(4 * 0.75 / 1.375) and (2, "meadow") not in got


def test_rules_that_would_lose_area_fail(spark):
    with pytest.raises(Exception, match="no shares for group field"):
        _ruled(spark, [x for x in SHARES if x[0] != "field"])[1].collect()
    with pytest.raises(Exception, match="do not sum to 1"):
        _ruled(spark, [(g, r, t, s / 2) for g, r, t, s in SHARES])[1].collect()


def test_raking_keeps_pixels_without_zone(spark):
    obs = spark.createDataFrame([(1, "z", "a", 10.0), (2, None, "a", 15.0), (2, None, "b", 5.0), (3, "z", "b", 2.0)], "pixel int, zone string, class string, area double")
    targets = spark.createDataFrame([("z", "a", 6.0), ("z", "b", 6.0)], "zone string, class string, area double")
    out = al.rake_to_targets(obs, targets, ["a", "b"], "pixel", "zone", "class", "area")
    ag.assert_conserved(obs, out, "area", ["pixel"])
    assert {(r["class"], r["area"]) for r in out.where("zone is null").collect()} == {("a", 15.0), ("b", 5.0)}


def test_pooling_keeps_groups_without_information(spark):
    rows = [("a", 1.0, 1.0), ("a", 2.0, 3.0), ("a", 4.0, 4.0), ("b", 5.0, 2.0), ("b", 7.0, 3.0), ("b", 6.0, 9.0), ("one", 9.0, 1.0), ("flat", 3.0, 2.0), ("flat", 3.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, y double, x double")
    for x in (None, "x"):
        got = {r["g"]: r for r in es.partial_pooling(df, "g", "y", x).collect()}
        assert set(got) == {"a", "b", "one", "flat"}
        assert all(got[g]["shrunk"] == pytest.approx(got[g]["pooled"]) for g in ("one", "flat"))


def test_window_wider_than_a_tile(spark):
    line = spark.createDataFrame([("s", i, 0, 1.0) for i in range(400)], "slice string, ix long, iy long, v double")
    reach = 150
    tiled = fo.with_halo(line, ["slice"], "ix", "iy", reach)
    near = tiled.alias("a").join(tiled.alias("b"), ["slice", "_tx", "_ty"]).where(f"abs(a.ix - b.ix) <= {reach}").where(fo.at_home("a.ix", "a.iy"))
    assert {r["n"] for r in near.where("a.ix = 200").groupBy("a.ix").agg(F.count("*").alias("n")).collect()} == {2 * reach + 1}


def test_null_groups_stay_in_splits_and_ranks(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else "g", float(i % 5) if i % 7 else None) for i in range(40)], "id int, g string, v double")
    assert sp.split_stratified(df, ["id"], "g", 0.25, 1).count() == 40
    ranked = average_ranks(df, ["g"], "v")
    assert ranked.count() == 40 and ranked.where("rank is null").count() == df.where("v is null").count()


def test_tile_guard_is_sequential(spark):
    """A large tile that is refused does not block its group for later tiles."""
    cells = [(x, y, "g") for x in range(60) for y in range(1)] + [(100 + x, 0, "g") for x in range(5)] + [(200 + x, 0, "g") for x in range(5)]
    df = spark.createDataFrame(cells, "ix long, iy long, g string")
    for seed in range(6):
        chosen = sp.choose_blocks(df, "ix", "iy", "g", 70, 20, 30, seed).collect()
        left, want = 70, set()
        order = df.withColumn("tile", fo.tile_key("ix", "iy", 70)).groupBy("tile").count().withColumn("h", hash_order(seed, "tile")).orderBy("h", "tile").collect()
        taken = 0
        for t in order:
            if taken < 20 and left - t["count"] >= 30:
                want.add(t["tile"])
                left, taken = left - t["count"], taken + t["count"]
        assert {r["tile"] for r in chosen} == want


def test_rules_table_is_checked(spark):
    with pytest.raises(ValueError):
        al.rules_from_table(spark.createDataFrame([(1, "rename")], "order int, action string"))
    with pytest.raises(ValueError):
        al.rules_from_table(spark.createDataFrame([(1, "drop", "a", "b")], "order int, action string, from_class string, to string"))


def test_raking_hits_targets_and_keeps_pixels(spark):
    rng = np.random.default_rng(1)
    obs = pd.DataFrame([(p, p % 3, c, float(rng.integers(1, 9))) for p in range(30) for c in "ABCD"], columns=["pixel", "zone", "class", "area"])
    tgt = pd.DataFrame([(z, c, float(rng.integers(1, 9))) for z in range(3) for c in "ABC"], columns=["zone", "class", "area"])
    o, t = spark.createDataFrame(obs), spark.createDataFrame(tgt)
    out = al.rake_to_targets(o, t, ["A", "B", "C"], "pixel", "zone", "class", "area").toPandas()
    assert np.allclose(out.groupby("pixel")["area"].sum(), obs.groupby("pixel")["area"].sum())
    got = out[out["class"] != "D"].groupby(["zone", "class"])["area"].sum()
    zone = obs[obs["class"] != "D"].groupby("zone")["area"].sum()
    for z, part in tgt.groupby("zone"):
        want = part.set_index("class")["area"] * zone[z] / part["area"].sum()
        assert np.allclose(got[z].reindex(want.index).fillna(0), want)


def test_carve_outs_conserve_area(spark):
    lu = spark.createDataFrame([(1, "A", 6.0), (1, "B", 4.0), (1, "G", 5.0), (2, "G", 3.0)], "cell int, class string, area double")
    flags = spark.createDataFrame([(1, 1.0)], "cell int, f double")
    out = al.carve_flag(lu, flags, "cell", "class", "area", "f", ["A", "B"], "IR")
    assert rows(out, "cell", "class", "area") == [(1, "A", 0.0), (1, "B", 0.0), (1, "G", 5.0), (1, "IR", 10.0), (2, "G", 3.0)]
    org = spark.createDataFrame([(1, 5.0, 50.0, 0.0, 1.5)], "cell int, cropland double, livestock double, mixed double, all_systems double")
    seq = al.carve_sequential(lu, org, "cell", "class", "area", ["A"], ["B"], ["G"])
    ag.assert_conserved(lu, seq, "area", ["cell"])
    got = {(r["cell"], r["class"]): r["area"] for r in seq.collect()}
    assert got[(1, "G")] == 0.0 and got[(1, "G999")] == 5.0 and math.isclose(got[(1, "A999")], 3.0 + 3.0 * 0.1)
    assert al.index_weight(2000, 2020, {2000: 3.0, 2020: 9.0}) == pytest.approx(1 / 3) and al.index_weight(1990, 2020, {}) == 1.0


def test_subtypes_are_coherent(spark):
    tot = spark.createDataFrame([("u1", "AT", "AT11", 2010, 100.0), ("u2", "AT", "AT12", 2010, 50.0)], "unit string, country string, region string, year int, total double")
    prod = spark.createDataFrame([("AT", 2010, 0.5, 0.3, 0.2)], "country string, year int, D double, O double, F double")
    dairy = spark.createDataFrame([("AT11", 2010, 0.8)], "region string, year int, dairy_share double")
    org = spark.createDataFrame([("AT", 2010, 0.25)], "country string, year int, organic_share double")
    out = al.allocate_subtypes(tot, prod, dairy, org, "country", "region", ["year"]).toPandas()
    assert np.allclose(out.groupby("unit")["heads"].sum(), [100.0, 50.0]) and (out["heads"] >= 0).all()
    assert math.isclose(out.query("unit == 'u1' and subtype == 'D'")["heads"].sum(), 80.0)
    assert math.isclose(out.query("unit == 'u1' and subtype == 'O'")["heads"].sum(), 20.0 * 0.6)


def test_dirichlet_draws(spark):
    df = spark.createDataFrame([("a", 90.0, 10.0, 0.0)], "k string, D double, O double, F double")
    s = al.sample_shares(df, ["k"], ["D", "O", "F"], 400, 3)
    pdf = s.toPandas()
    assert np.allclose(pdf[["D", "O", "F"]].sum(axis=1), 1.0) and abs(pdf["D"].mean() - 90.5 / 101.5) < 0.01
    assert pdf.equals(al.sample_shares(df.repartition(3), ["k"], ["D", "O", "F"], 400, 3).toPandas())


# ---- design and screens ----------------------------------------------------------------------------------------


def test_nest_paths():
    auto = de.nest_paths(["Forests_HI", "Forests_LI", "Urban", "Cropland_arable_low", "Cropland_arable_high", "Cropland_perm"], "AUTO")
    assert auto["Urban"] == [] and auto["Forests_HI"] == ["Forests"]
    assert auto["Cropland_arable_low"] == ["Cropland", "Cropland_arable"] and auto["Cropland_perm"] == ["Cropland"]
    org = de.paths_by_prefix(["A_x", "A_y", "B"])
    assert org == {"A_x": ["A"], "A_y": ["A"], "B": []}
    crops = de.SCHEMES["PREFIX_ORGANIC"](["Cropland_HI", "Cropland_LI", "Cropland_HIO", "Cropland_LIO"])
    assert crops["Cropland_HIO"] == ["Cropland", "Cropland/organic"]
    with pytest.raises(ValueError):
        de.check_paths({"a": ["n"], "b": []}, ["a", "b"])
    with pytest.raises(ValueError):
        de.nest_paths(["a"], "nothing")


def test_conflicting_mapping_rows_fail(spark):
    df = spark.createDataFrame([("a", "n", ""), ("a", "m", "")], "class string, l1 string, l2 string")
    with pytest.raises(PySparkException, match="two paths"):
        de.paths_from_mapping(df, "class", ["l1", "l2"]).collect()


def test_group_means_refuse_unseen_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 6.0)], "g string, x double")
    spec = de.group_mean_design(df, "g", ["x"])
    assert [round(v, 6) for v in sorted(r[spec.names[0]] for r in de.apply_group_mean_design(spec, df).collect())] == [-0.707107, -0.707107, 0.707107]
    with pytest.raises(PySparkException, match="not seen"):
        de.apply_group_mean_design(spec, spark.createDataFrame([("z", 1.0)], "g string, x double")).collect()
    with pytest.raises(ValueError):
        de.group_mean_design(df.withColumn("x", F.lit(1.0)), "g", ["x"])


def test_recipe_replays_exactly(spark):
    cells = spark.createDataFrame([(2000, i, j, "AT" if i < 3 else "DE", float(i), float(j + 1), 2.0) for i in range(6) for j in range(6)], "yr int, ix int, iy int, g string, z double, A double, B double")
    design, recipe = de.build_recipe(cells, key=["yr", "ix", "iy"], features=["log1p_z"], classes=["A", "B"], lattice=("ix", "iy"), slices=["yr"], group="g", transforms=[{"fn": "log1p", "cols": ["z"], "prefix": "log1p_"}])
    again = de.apply_recipe(recipe, cells)
    drift = de.recipe_check(design, again, ["yr", "ix", "iy"], recipe.col_order)
    assert all(r["max_d"] == 0.0 for r in drift.collect())
    other = de.apply_recipe(recipe, cells.withColumn("g", F.lit("FR")))
    assert other.where(F.col("group_known").isNotNull()).count() == 0


def test_correlations_decorrelation_and_rank(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(d=x[:, 0] + 0.05 * rng.normal(size=400), e=x[:, 1] - x[:, 2], one=1.0, g=["u", "v"] * 200)
    df = spark.createDataFrame(pdf).repartition(5)
    assert np.allclose(sc.correlation_matrix(df, ["a", "b", "c", "d"]), np.corrcoef(pdf[["a", "b", "c", "d"]].T))
    assert sc.decorrelate(df, ["a", "b", "c", "d"], 0.9, protect=["d"]) == ["b", "c", "d"]
    assert sc.decorrelate(df, ["a", "b", "c", "d"], 0.9, prefer=["a"]) == ["a", "b", "c"]
    assert sc.rank_guard(df, ["one", "a", "b", "c", "e"], "one") == {"e": "dependent"}
    by = sc.pair_moments(df, ["a", "b"], "g").where("a = 'a' and b = 'b'").collect()
    for r in by:
        part = pdf[pdf["g"] == r["g"]]
        assert math.isclose(r["corr"], np.corrcoef(part["a"], part["b"])[0, 1], rel_tol=1e-9)


# ---- scoring ---------------------------------------------------------------------------------------------------


def coef_rows(spark, mats):
    return spark.createDataFrame([(g, [[float(v) for v in row] for row in m]) for g, m in mats.items()], "grp string, b array<array<double>>")


def test_zero_coefficients_shift_and_unseen(spark):
    x = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "new", [1.0, -1.0])], "row int, grp string, x array<double>")
    zero = so.predict_shares(x, coef_rows(spark, {"a": np.zeros((3, 2)), so.POOLED: np.zeros((3, 2))}), "grp").collect()
    assert all(np.allclose(r["p"], 1 / 3) for r in zero)
    m = np.array([[0.3, 1.0], [0.1, -0.5], [0.0, 0.2]])
    base = so.predict_shares(x, coef_rows(spark, {"a": m, so.POOLED: -m}), "grp").orderBy("row").collect()
    moved = so.predict_shares(x, coef_rows(spark, {"a": m + [[7.0, 0.0]], so.POOLED: -m}), "grp").orderBy("row").collect()
    assert np.allclose(base[0]["p"], moved[0]["p"]) and not base[0]["pooled"] and base[1]["pooled"]
    u = -m @ np.array([1.0, -1.0])
    assert np.allclose(base[1]["p"], np.exp(u) / np.exp(u).sum())
    wide = so.predict_shares(x, coef_rows(spark, {"a": m, so.POOLED: -m}), "grp", class_map=[0, 0, 1, 2]).orderBy("row").first()["p"]
    assert np.allclose([wide[0] + wide[1], wide[2], wide[3]], base[0]["p"])


def test_large_coefficient_tables_are_joined(spark, monkeypatch):
    x = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "new", [1.0, -1.0])], "row int, grp string, x array<double>")
    m = np.array([[0.3, 1.0], [0.1, -0.5], [0.0, 0.2]])
    coef = coef_rows(spark, {"a": m, so.POOLED: -m})
    small = so.predict_shares(x, coef, "grp", class_map=[0, 0, 1, 2]).orderBy("row").collect()
    monkeypatch.setattr(so, "CHUNK_BYTES", 8)
    large = so.predict_shares(x, coef, "grp", class_map=[0, 0, 1, 2]).orderBy("row").collect()
    for a, b in zip(small, large):
        assert np.allclose(a["p"], b["p"]) and np.allclose(a["u"], b["u"]) and a["pooled"] == b["pooled"]


def test_predictive_chunks_agree(spark):
    rng = np.random.default_rng(4)
    x = spark.createDataFrame([(i, f"g{i % 3}", [1.0, float(v)]) for i, v in enumerate(rng.normal(size=30))], "row int, grp string, x array<double>")
    mats = {(g, d): rng.normal(size=(3, 2)) for g in ("g0", "g1", so.POOLED) for d in range(1, 8)}
    draws = spark.createDataFrame([(g, d, m.tolist()) for (g, d), m in mats.items()], "grp string, draw int, b array<array<double>>")
    one = so.predict_predictive(x, draws, ["row"], "grp", "draw", 3).orderBy("row").collect()
    many = so.predict_predictive(x, draws, ["row"], "grp", "draw", 3, chunk_bytes=300).orderBy("row").collect()
    for a, b, r in zip(one, many, x.orderBy("row").collect()):
        g = r["grp"] if r["grp"] != "g2" else so.POOLED
        ps = [np.exp(mats[(g, d)] @ r["x"]) for d in range(1, 8)]
        assert np.allclose(a["p"], np.mean([p / p.sum() for p in ps], axis=0)) and np.allclose(a["p"], b["p"]) and a["n_draws"] == 7


def test_softmax_expression(spark):
    r = spark.range(1).select(so.softmax(F.array(F.lit(1000.0), F.lit(1001.0))).alias("p")).first()["p"]
    assert np.allclose(r, [1 / (1 + math.e), math.e / (1 + math.e)])


def test_trees_walk_like_a_plain_reader(spark):
    rng = np.random.default_rng(5)

    def grow(depth):
        if depth == 0 or rng.random() < 0.25:
            return [(-1, float(rng.normal()))]
        return [(int(rng.integers(0, 3)), float(rng.normal()))] + grow(depth - 1) + grow(depth - 1)

    def read(nodes, x, at=0):
        var, val = nodes[at]
        if var == -1:
            return val, at + 1
        left, after = read(nodes, x, at + 1)
        right, end = read(nodes, x, after)
        return (left if x[var] <= val else right), end

    trees = {(d, e, t): grow(4) for d in (1, 2, 3) for e in ("A", "B") for t in (1, 2)}
    nodes = spark.createDataFrame([(d, e, t, n, v, s) for (d, e, t), ns in trees.items() for n, (v, s) in enumerate(ns)], "draw int, ensemble string, tree int, node int, var int, value double")
    x = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "row int, x array<double>")
    for chunk in (1 << 20, 300):
        got = {r["row"]: r["f"] for r in ds.ensemble_means(df, ds.tree_parts(nodes), ["row"], "x", ["A", "B"], 1.0, chunk_bytes=chunk, block_rows=7).collect()}
        for i, row in enumerate(x):
            for j, e in enumerate(("A", "B")):
                per = [np.clip(sum(read(trees[(d, e, t)], row)[0] for t in (1, 2)), -1, 1) for d in (1, 2, 3)]
                assert math.isclose(got[i][j], np.mean(per), abs_tol=1e-12)


def nested_by_hand(tree, mats, deltas, x, z):
    """Class probabilities of one row under one draw, by plain recursion from the root."""
    nodes = {n.name: n for n in tree.nodes}

    def child_utilities(name):
        n = nodes[name]
        if name not in mats:
            return None
        f = [sum(x[c] for c in g) for g in n.routes] + [inclusive(c) for c in n.iv]
        u = mats[name] @ np.array(f)
        return u + deltas[name] * z[n.slot : n.slot + len(n.children)] if n.slot is not None else u

    def inclusive(name):
        u = child_utilities(name)
        return 0.0 if u is None else math.log(sum(math.exp(v) for v in u))

    def down(name, p):
        if name not in nodes:
            return {name: p}
        u = child_utilities(name)
        w = np.full(len(nodes[name].children), 1 / len(nodes[name].children)) if u is None else np.exp(u) / np.exp(u).sum()
        return {k: v for c, q in zip(nodes[name].children, w) for k, v in down(c, p * q).items()}

    found = down("root", 1.0)
    return np.array([found[c] for c in tree.classes])


@pytest.fixture(scope="module")
def nested_case(spark):
    """Three levels, an even node, routed columns, a nest without inclusive value, alternative terms, an unseen group, four draws."""
    rng = np.random.default_rng(8)
    paths = {"a1": ["A", "AA"], "a2": ["A", "AA"], "a3": ["A"], "b1": ["B"], "b2": ["B"], "e1": ["E"], "e2": ["E"], "c": []}
    tree = ne.nest_tree(paths, ["x0", "x1", "x2"], {"A": [["x0"], ["x1", "x2"]]}, no_iv=["B"], alternatives=["root", "B"])
    fitted = [n for n in tree.nodes if n.name != "E"]
    mats = {(g, d, n.name): rng.normal(size=(len(n.children), n.features)) for g in ("g0", "g1", so.POOLED) for d in (1, 2, 5, 9) for n in fitted}
    deltas = {(d, name): rng.normal(size=k) for d in (1, 2, 5, 9) for name, k in (("root", 4), ("B", 2))}
    model = spark.createDataFrame(
        [(d, "node", g, n, None, m.ravel().tolist()) for (g, d, n), m in mats.items()] + [(d, "delta", n, None, None, v.tolist()) for (d, n), v in deltas.items()], ds.PARTS)
    data = [(i, f"g{i % 3}", [1.0, *rng.normal(size=2).tolist()], rng.normal(size=6).tolist()) for i in range(40)]
    return tree, mats, deltas, model, data, spark.createDataFrame(data, "row int, grp string, x array<double>, z array<double>")


def hand_draw(case, row, d, x=None):
    tree, mats, deltas, *_ = case
    g = row[1] if row[1] != "g2" else so.POOLED
    return nested_by_hand(tree, {n: m for (h, e, n), m in mats.items() if (h, e) == (g, d)}, {n: v for (e, n), v in deltas.items() if e == d}, row[2] if x is None else x, np.array(row[3]))


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 7, "chunk_bytes": 900}])
def test_nested_prediction_equals_recursion(nested_case, sizes):
    tree, _, _, model, data, df = nested_case
    got = {r["row"]: r for r in ne.predict_nested(df, model, ["row"], "grp", tree, z="z", **sizes).collect()}
    for row in data:
        assert got[row[0]]["n_draws"] == 4
        assert np.allclose(got[row[0]]["p"], np.mean([hand_draw(nested_case, row, d) for d in (1, 2, 5, 9)], axis=0), atol=1e-12)


def test_nested_effects_equal_differences(nested_case):
    tree, _, _, model, data, df = nested_case
    got = {(r["draw"], r["class"], r["cov"]): r["ame"] for r in ne.effect_draws(df, model, ["row"], "grp", tree, ["x0", "x1", "x2"], z="z", block_rows=9, chunk_bytes=900).collect()}
    h = 1e-5
    for d in (1, 2, 5, 9):
        want = np.zeros((len(tree.classes), 3))
        for row in data:
            for j in range(3):
                up, down = (hand_draw(nested_case, row, d, [v + s * h * (k == j) for k, v in enumerate(row[2])]) for s in (1, -1))
                want[:, j] += (np.log(up) - np.log(down)) / (2 * h) / len(data)
        want -= want.mean(axis=0)
        for i, c in enumerate(tree.classes):
            for j in range(3):
                assert math.isclose(got[d, c, f"x{j}"], want[i, j], abs_tol=1e-7)


def test_unfitted_group_without_pooled_coefficients_is_an_error(spark, nested_case):
    tree, _, _, model, _, df = nested_case
    with pytest.raises(Exception, match="not fitted"):
        ne.predict_nested(df, model.where(F.coalesce("a", F.lit("")) != so.POOLED), ["row"], "grp", tree, z="z").collect()


def test_count_draws_with_dispersion_and_stored_cap(spark):
    rng = np.random.default_rng(3)
    mats = {d: rng.normal(size=(2, 2)) for d in range(1, 6)}
    r = {d: rng.uniform(0.5, 2, size=2) for d in mats}
    model = spark.createDataFrame([(d, "coef", so.POOLED, None, None, m.ravel().tolist()) for d, m in mats.items()] + [(d, "dispersion", None, None, None, v.tolist()) for d, v in r.items()], ds.PARTS)
    data = [(i, None, [1.0, float(v)], 0.1 * i) for i, v in enumerate(rng.normal(size=20))]
    df = spark.createDataFrame(data, "row int, grp string, x array<double>, off double")
    stored = spark.createDataFrame([("A", "99%", 1.2), ("B", "99%", 2.5), ("A", "100%", 9.0)], "class string, quantile string, density double")
    out = ds.predictive_counts(ds.stored_cap(df, stored, "99%", ["A", "B"]), model, ["row"], "grp", "off", 2, cap="cap", chunk_bytes=200, block_rows=6)
    got = {x["row"]: x["mu"] for x in out.collect()}
    for i, _, x, off in data:
        want = np.mean([np.minimum(r[d] * np.exp(m @ x), [1.2, 2.5]) * math.exp(off) for d, m in mats.items()], axis=0)
        assert np.allclose(got[i], want)
    with pytest.raises(Exception, match="no stored quantile"):
        ds.stored_cap(df, stored, "100%", ["A", "B"]).collect()


def test_row_moments_merge_over_chunks(spark):
    rng = np.random.default_rng(2)
    mats = {d: rng.normal(size=(1, 2)) for d in range(1, 12)}
    model = spark.createDataFrame([(d, "coef", so.POOLED, None, None, m.ravel().tolist()) for d, m in mats.items()], ds.PARTS)
    data = [(i, "g", [1.0, float(v)], float(i % 4)) for i, v in enumerate(rng.normal(size=15))]
    df = spark.createDataFrame(data, "row int, grp string, x array<double>, y double")
    got = {r["row"]: r for r in ds.pointwise_moments(df, model, ["row"], "grp", 1, me.poisson_draws("y"), ["y"], chunk_bytes=200, block_rows=4).collect()}
    for i, _, x, y in data:
        eta = np.array([float((m @ x)[0]) for m in mats.values()])
        ll = y * eta - np.exp(eta) - math.lgamma(y + 1)
        assert got[i]["n"] == 11 and math.isclose(got[i]["lpd"], math.log(np.mean(np.exp(ll)))) and math.isclose(got[i]["p"], np.var(ll, ddof=1))


# ---- draws -----------------------------------------------------------------------------------------------------


def draw_table(spark, chains, n, params=("p",), fn=None):
    rng = np.random.default_rng(6)
    one = {p: rng.normal(size=n) for p in params}
    data = [(p, c, i + 1, float(one[p][i] if fn is None else fn(rng, c, i))) for p in params for c in range(chains) for i in range(n)]
    return spark.createDataFrame(data, "param string, chain int, iter int, value double")


def test_rhat_of_identical_chains(spark):
    got = dr.rhat(draw_table(spark, 4, 50), ["param"]).first()["rhat"]
    assert math.isclose(got, math.sqrt(49 / 50), rel_tol=1e-9)


def test_diagnostics_tell_good_from_bad(spark):
    good = draw_table(spark, 4, 200, fn=lambda r, c, i: r.normal())
    bad = draw_table(spark, 4, 200, fn=lambda r, c, i: c + r.normal())
    assert dr.rhat_rank(good, ["param"]).first()["rhat"] < 1.03 < dr.rhat_rank(bad, ["param"]).first()["rhat"]
    size = dr.ess_bulk(good, ["param"]).first()
    assert 500 < size["ess"] < 1200 and not size["lag_limited"]
    assert dr.ess_bulk(bad, ["param"]).first()["ess"] < 100
    assert dr.ess_tail(good, ["param"]).first()["ess"] > 300


def test_effective_size_over_several_lag_ranges(spark, monkeypatch):
    def slow(r, c, i):
        slow.x = 0.0 if i == 0 else 0.9 * slow.x + r.normal()
        return slow.x

    draws = draw_table(spark, 3, 300, fn=slow)
    want = {r["param"]: (r["ess"], r["lag_limited"]) for r in dr.ess_bulk(draws, ["param"]).collect()}
    monkeypatch.setattr(dr, "FIRST_LAGS", 4)
    monkeypatch.setattr(dr, "MOST_LAGS", 8)
    got = {r["param"]: (r["ess"], r["lag_limited"]) for r in dr.ess_bulk(draws, ["param"]).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[p][0], want[p][0], rel_tol=1e-9) and got[p][1] == want[p][1] for p in want)
    assert all(10 < e < 200 for e, _ in got.values())


def test_contrasts_are_antisymmetric(spark):
    rng = np.random.default_rng(8)
    d = spark.createDataFrame([("x", c, i, float(rng.normal())) for c in "ABC" for i in range(60)], "cov string, class string, iter int, value double")
    out = dr.contrasts(d, ["cov"], ["iter"], "class", "value", ["A", "B", "C"]).toPandas().set_index(["from_class", "to_class"])
    for a, b in (("A", "B"), ("A", "C"), ("B", "C")):
        assert math.isclose(out.loc[(a, b), "median"], -out.loc[(b, a), "median"]) and math.isclose(out.loc[(a, b), "q025"], -out.loc[(b, a), "q975"])


def test_field_moments_against_numpy(spark):
    rng = np.random.default_rng(9)
    f = rng.normal(size=(50, 5))
    df = spark.createDataFrame(pd.DataFrame(f, columns=list("abcde")))
    fields, weights, test = dr.field_moments(df, list("abcde"), 2)
    pdf = fields.toPandas()
    assert np.allclose(pdf["field_0"], f.mean(axis=1)) and math.isclose(sum(weights.values()), 1.0) and weights["field_1p"] == pytest.approx(1 / 6)
    c = f - f.mean(axis=1, keepdims=True)
    lam = np.sort(np.linalg.eigvalsh(c.T @ c))[::-1]
    assert math.isclose(((pdf["field_1p"] - pdf["field_0"]) ** 2).sum(), 3 * lam[0] / 4, rel_tol=1e-9)
    assert isinstance(test["gaussian"], bool)
    single, w1, t1 = dr.field_moments(df.select("a"), ["a"], 3)
    assert w1 == {"field_0": 1.0} and t1["gaussian"] and single.columns == ["a", "field_0"]


# ---- metrics, estimators, functions ----------------------------------------------------------------------------


def test_perfect_prediction(spark):
    df = spark.createDataFrame([(1, "a", 0.25), (1, "b", 0.75), (2, "a", 0.5), (2, "b", 0.5)], "row int, class string, obs double").withColumn("pred", F.col("obs"))
    r = me.share_fit(df, "class", "obs", "pred").first()
    assert math.isclose(r["normalised"], 1.0) and r["ll"] == pytest.approx(r["ll_perfect"])
    assert me.brier_log_score(df, "row", "obs", "pred").first()["brier"] == 0.0
    assert me.mad_tvd(df, "row", "obs", "pred").first()["mean_tvd"] == 0.0


def test_special_functions(spark):
    xs = [0.1, 0.5, 1.0, 3.7, 50.0, 1e5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(scalar.lgamma(F.col("x"))).collect()]
    assert np.allclose(got, [math.lgamma(x) for x in xs], rtol=1e-11, atol=1e-12)
    ps = [1e-6, 0.01, 0.3, 0.5, 0.975, 1 - 1e-6]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select("p", scalar.normal_icdf(F.col("p")).alias("z"))
    back = df.select("p", scalar.normal_upper_tail(F.col("z")).alias("q")).collect()
    assert np.allclose([1 - r["q"] for r in back], ps, atol=2e-7)


def test_share_logit_recovers_coefficients(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 1))
    u = np.column_stack([0.5 + 1.0 * x[:, 0], -0.5 - 1.0 * x[:, 0]])
    p = np.exp(u) / np.exp(u).sum(axis=1, keepdims=True)
    xs = spark.createDataFrame(pd.DataFrame({"row": np.arange(3000), "x1": x[:, 0]}))
    ys = spark.createDataFrame(pd.DataFrame({"row": np.repeat(np.arange(3000), 2), "class": ["a", "b"] * 3000, "share": p.ravel()}))
    got = {(r["cov"], r["class"]): r["beta"] for r in es.fit_share_logit(xs, ys, "row", ["x1"], ["a", "b"]).collect()}
    assert got[("intercept", "a")] == pytest.approx(0.5, abs=0.01) and got[("x1", "a")] == pytest.approx(1.0, abs=0.01)
    assert got[("x1", "a")] == pytest.approx(-got[("x1", "b")])


def test_count_fit_recovers_slope(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=2000)
    y = rng.poisson(np.exp(0.3 + 0.5 * x + math.log(10)))
    df = spark.createDataFrame(pd.DataFrame({"y": y, "x1": x, "off": math.log(10)}))
    coef, r = es.fit_count(df, "y", ["x1"], "off")
    got = dict(rows(coef, "cov", "beta"))
    assert got["x1"] == pytest.approx(0.5, abs=0.03) and got["intercept"] == pytest.approx(0.3, abs=0.03) and r > 20


def test_poisson_weights_have_mean_one(spark):
    w = spark.range(4000).select(es.poisson_weight(3, "id").alias("w")).toPandas()["w"]
    assert abs(w.mean() - 1) < 0.06 and abs(w.var() - 1) < 0.12


# ---- null keys in allocations --------------------------------------------------------------------------------------


def test_allocations_keep_rows_of_null_classes(spark):
    schema = "cell int, class string, area double"
    df = spark.createDataFrame([(1, "a", 6.0), (1, None, 5.0), (2, "b", 4.0), (None, "a", 3.0)], schema)
    flags = spark.createDataFrame([(1, 0.5)], "cell int, f double")
    total = lambda out, c="area": out.agg(F.sum(c)).first()[0]
    assert total(al.carve_flag(df, flags, "cell", "class", "area", "f", ["a"], "new")) == 18.0
    geo = spark.createDataFrame([(1, "X"), (2, None)], "cell int, geo string")
    shares = spark.createDataFrame([("g", "X", "p", 0.25), ("g", "X", "q", 0.75)], "group string, geo string, target string, share double")
    ruled = al.apply_class_rules(df, [{"action": "split", "from": "a", "to": "g"}, {"action": "rename", "from": "b", "to": "c"}], shares, geo, "cell", "class", "area")
    assert total(ruled) == 18.0 and total(ruled.where("class is null")) == 5.0
    obs = df.withColumn("zone", F.when(F.col("cell") == 1, "z"))
    targets = spark.createDataFrame([("z", "a", 1.0), ("z", "b", 1.0), (None, "a", 1.0)], "zone string, class string, area double")
    raked = al.rake_to_targets(obs, targets, ["a", "b"], "cell", "zone", "class", "area")
    assert total(raked) == pytest.approx(18.0) and total(raked.where("class is null")) == 5.0


def test_missing_parameters_are_errors_and_null_countries_meet(spark):
    x = spark.createDataFrame([(1, "A", "d", 1.0), (2, None, "d", 2.0)], "unit int, country string, driver string, value double")
    gamma = [("A", "c1", "d", 0.1), ("A", "c2", "d", 0.3), (None, "c1", "d", 0.2), (None, "c2", "d", 0.2)]
    schema = "country string, cell string, driver string, gamma double"
    totals = spark.createDataFrame([(1, 10.0), (2, 5.0)], "unit int, total double")
    out = al.allocate_by_weights(x, spark.createDataFrame(gamma, schema), totals, "unit", "country", "driver", "cell", ["unit"])
    assert out.agg(F.sum("heads")).first()[0] == pytest.approx(15.0)
    with pytest.raises(Exception, match="no coefficients"):
        al.allocate_by_weights(x, spark.createDataFrame(gamma[:2], schema), totals, "unit", "country", "driver", "cell", ["unit"]).collect()
    with pytest.raises(Exception, match="no unit"):
        al.allocate_by_weights(x.where("unit = 1"), spark.createDataFrame(gamma, schema), totals, "unit", "country", "driver", "cell", ["unit"]).collect()
    heads = spark.createDataFrame([("A", "r", 2000, 8.0), (None, "s", 2000, 4.0)], "country string, region string, year int, total double")
    parts = [("A", 2000, 0.5, 0.25, 0.25), (None, 2000, 1.0, 0.0, 0.0)]
    dairy = spark.createDataFrame([], "region string, year int, dairy_share double")
    organic = spark.createDataFrame([], "country string, year int, organic_share double")
    make = lambda rows_: spark.createDataFrame(rows_, "country string, year int, D double, O double, F double")
    assert al.allocate_subtypes(heads, make(parts), dairy, organic, "country", "region", ["year"]).agg(F.sum("heads")).first()[0] == 12.0
    with pytest.raises(Exception, match="no production shares"):
        al.allocate_subtypes(heads, make(parts[:1]), dairy, organic, "country", "region", ["year"]).collect()


def test_slices_are_tall_and_moved_bytes_follow_the_input():
    first = next(ds.slices(150_000, 10_256, 4))
    assert first[0].stop >= 1000  # the loops run along rows, whatever the number of draws
    def moved(scale):
        rows, model = scale * 20 * 2**20, scale * 10 * 2**20
        blocks, chunks = ds.dealt(scale * 150_000, rows, scale * 50_000, model, 12, ds.BLOCK_ROWS, ds.CHUNK_BYTES)
        assert rows / blocks <= ds.BLOCK_BYTES and model / chunks <= ds.CHUNK_BYTES and blocks * chunks >= 12
        return blocks * model + chunks * rows
    assert moved(10) <= 11 * moved(1) and moved(60) <= 66 * moved(1)


def test_forest_scores_many_trees_of_mixed_shapes():
    from gridpanel.operators import trees as tr

    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3))
    shapes = [[1, -1, 2, -1, -1], [0, 2, -1, -1, -1], [-1]]
    table = [(d, "tree", e, str(k), v, rng.normal(size=len(v)).tolist()) for d in (3, 5, 9, 11) for e in ("A", "B") for k, v in enumerate([shapes[(d + len(e)) % 3], shapes[0], shapes[0]])]
    names = ("draw", "kind", "a", "b", "ints", "vals")
    chunk = ds.Chunk(pa.table({c: pa.array([r[i] for r in table]) for i, c in enumerate(names)}))
    for draws in ([3, 5, 9, 11], [5, 9], [9, 10]):
        want = np.zeros((500, len(draws), 2))
        for d, _, e, _, var, value in table:
            if d in draws:
                want[:, draws.index(d), "AB".index(e)] += tr.walk(x, np.array(var), np.array(value), tr.right_children(np.array(var)))
        assert np.allclose(chunk.ensemble(x, ["A", "B"], draws, 1.5), np.clip(want, -1.5, 1.5))


def test_nested_effects_sum_over_rows_by_weights():
    covs = ["x0", "x1"]
    tree = ne.nest_tree({"A": ["m", "n"], "B": ["m", "n"], "C": ["m"], "D": []}, covs)
    rng = np.random.default_rng(8)
    mats = {k.name: rng.normal(size=(3, len(k.children), k.features)) for k in tree.nodes}
    x = rng.normal(size=(40, 2))

    def logs(x):
        shares = ne._evaluate(tree, x, None, mats, {})
        return np.stack([sum(np.log(shares[node][k]) for node, k in tree.steps[c]).sum(axis=1) for c in tree.classes], axis=1)

    got = ne._effects(tree, x, None, mats, {})
    for j in range(2):
        h = np.eye(2)[j] * 1e-6
        assert np.allclose(got[:, :, j], (logs(x + h) - logs(x - h)) / 2e-6, atol=1e-5)


def test_rows_that_repeat_a_key_stay_apart_over_chunks(spark):
    model = ds.matrix_parts(spark.createDataFrame([(ds.POOLED, d, [[0.1 * d, 0.2], [0.0, 0.0]]) for d in range(40)], "grp string, draw int, b array<array<double>>"), "grp", "draw")
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [1.0, 2.0])], "row int, x array<double>").withColumn("grp", F.lit("a"))
    one, many = (sorted((r["row"], r["n_draws"], round(r["p"][0], 9)) for r in ds.predictive_shares(rows, model, ["row"], "grp", 2, **kw).collect()) for kw in ({}, {"chunk_bytes": 300}))
    assert one == many and [r[1] for r in one] == [40] * 4


def test_fits_are_one_pass_and_intercepts_read_a_written_table(spark, tmp_path):
    orders = [(k, k % 7, 1000.0 * k, f"{k % 5 + 1}-X", dt.date(1995, 1, 1 + k % 28)) for k in range(60)] + [(3, 3, 9.0, "1-X", dt.date(1995, 1, 1))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string, o_orderdate date").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(c, c % 2) for c in range(7)], "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    lines = [(k, "ANR"[(k + i) % 3], float(1 + (k * i) % 9)) for k in range(60) for i in range(3)]
    spark.createDataFrame(lines, "l_orderkey long, l_returnflag string, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    t = Tables(spark, str(tmp_path))
    rows = t.fits.collect()
    assert len(rows) == 61 * 3 and abs(sum(r["pred"] for r in rows) - 60) < 1e-9  # an order that comes twice shares its total
    assert all(abs(sum(r["obs"] for r in rows if r["row"] == k) - 1) < 1e-9 for k in range(4, 60))
    plan = t.fits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem") + plan.count("l_quantity#") > 0 and plan.count("Relation") <= 6  # orders, customer and lineitem, and again for the group sums


def test_shuffles_are_dealt_by_the_size_of_the_tables(spark, tmp_path):
    from gridpanel import session

    (tmp_path / "x.parquet").write_bytes(b"0" * (20 * session.INPUT_BYTES))
    session.deal_by_size(spark, str(tmp_path))
    assert int(spark.conf.get(session.INITIAL)) == 20 and int(spark.conf.get(session.ADVISORY).rstrip("b")) == session.TASK_BYTES
    session.deal_as_set(spark)
    assert spark.conf.get(session.INITIAL, None) is None


def _counted(spark, df, col):
    """``df`` and the number of times that a value of ``col`` has been computed."""
    times = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def same(v):
        times.add(1)
        return v

    return df.withColumn(col, same(col)), times


def test_compare_arms_computes_its_inputs_once(spark):
    from gridpanel.operators import estimate as es

    x = spark.createDataFrame([(i, float(i % 3), float(i % 4)) for i in range(30)], "row long, a double, b double")
    y = spark.createDataFrame([(i, c, 0.25 + 0.5 * (i % 2 == (c == "B"))) for i in range(30) for c in "AB"], "row long, class string, share double")
    plain = es.compare_arms(x, y, "row", ["a"], ["b"], ["A", "B"], F.col("row") % 3 != 0, max_iter=5)
    (x, of_x), (y, of_y) = _counted(spark, x, "b"), _counted(spark, y, "share")
    out = es.compare_arms(x, y, "row", ["a"], ["b"], ["A", "B"], F.col("row") % 3 != 0, max_iter=5)
    assert {r["class"]: round(r["obs"], 9) for r in out.collect()} == {r["class"]: round(r["obs"], 9) for r in plain.collect()} and out.count() == 2
    assert (of_x.value, of_y.value) == (30, 60)


def test_projection_computes_the_lattice_once(spark):
    from gridpanel.queries import load_all
    from gridpanel.queries.base import Tables
    from gridpanel.queries.spatial import CLASSES

    rows = [(2000, i, j, c, 1.0 + (i + j + k) % 3) for i in range(4) for j in range(4) for k, c in enumerate(CLASSES)]
    for name, n in (("q12_project_step", 16), ("q12_projection_trajectory", 3)):
        t = Tables(spark, "")
        t.lattice, times = _counted(spark, spark.createDataFrame(rows, "slice int, ix long, iy long, class string, area double"), "area")
        assert load_all()[name].fn(t).count() == n and times.value == len(rows)


def _elements(monkeypatch, name):
    """How many numbers ``np.<name>`` has been asked for."""
    plain, seen = getattr(np, name), [0]

    def counted(x, *args, **kw):
        seen[0] += np.size(x)
        return plain(x, *args, **kw)

    monkeypatch.setattr(np, name, counted)
    return seen


def test_shares_take_an_exponential_less_and_stay_right_at_the_ends(monkeypatch):
    rng = np.random.default_rng(4)
    x, b = np.column_stack((np.ones(50), rng.normal(size=(50, 2)))), rng.normal(size=(7, 4, 3))
    want = ds.np_softmax(np.einsum("rc,dkc->rdk", x, b)).transpose(2, 1, 0)
    with monkeypatch.context() as m:
        seen = _elements(m, "exp")
        got = ds.shares(x, b)
    assert np.allclose(got, want, rtol=1e-13, atol=0) and seen[0] == 3 * 7 * 50
    far = b * np.array([1, 1e3, 1e3])  # beyond the doubles, and a row without a value
    y = np.vstack((x, [[1, np.nan, 0]]))
    with np.errstate(invalid="ignore"):
        got, want = ds.shares(y, far), ds.np_softmax(np.einsum("rc,dkc->rdk", y, far)).transpose(2, 1, 0)
    assert np.allclose(got[:, :, :50], want[:, :, :50], atol=1e-12) and np.isnan(got[:, :, 50]).all() and np.allclose(got[:, :, :50].sum(axis=0), 1)


def test_trees_are_settled_for_rows_that_lie_close():
    from gridpanel.operators import trees as tr

    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 3))
    x[::500, 1] = np.nan  # goes right
    shapes = [[1, -1, 2, -1, -1], [2, 1, -1, -1, -1]]
    table = [(d, "tree", e, "1", shapes[d % 2], rng.normal(size=5).tolist()) for d in range(60) for e in ("A", "B")]
    chunk = ds.Chunk(pa.table({c: pa.array([r[i] for r in table]) for i, c in enumerate(("draw", "kind", "a", "b", "ints", "vals"))}))
    assert set(chunk.split_on(["A", "B"])) == {1, 2}
    order, walked = ds.nearby(x, [1, 2], 64), 0
    assert sorted(order) == list(range(4000))
    for i in range(0, 4000, 64):
        some = x[order[i : i + 64]]
        terms = ds.Grown(chunk, some, ["A", "B"], list(range(60)), 0.9)
        for part in (slice(0, 25), slice(25, 60)):
            for (flat, open_, value), e in zip(terms.at(part), "AB", strict=True):
                walked += len(open_)
                got = np.repeat(flat[:, None], len(some), axis=1)
                got[open_] = value
                trees = {d: (np.array(v), np.array(s)) for d, _, f, _, v, s in table if f == e}
                want = [np.clip(tr.walk(some, trees[d][0], trees[d][1], tr.right_children(trees[d][0])), -0.9, 0.9) for d in range(part.start, part.stop)]
                assert np.array_equal(got, np.array(want))
    assert walked < 0.5 * 63 * 120  # most trees have one value for all rows


def test_nested_shares_take_few_exponentials(monkeypatch):
    tree = ne.nest_tree({"A": ["m"], "B": ["m"], "C": [], "D": []}, ["x0", "x1"])
    rng = np.random.default_rng(9)
    mats = {k.name: rng.normal(size=(6, len(k.children), k.features)) for k in tree.nodes}
    x = rng.normal(size=(30, 2))
    with monkeypatch.context() as m:
        seen = _elements(m, "exp")
        got = ne._evaluate(tree, x, None, mats, {})
    assert seen[0] == (1 + 2) * 6 * 30  # a child less in each node
    u = np.einsum("dkc,rc->kdr", mats["m"], x)
    v = np.einsum("dkc,rc->kdr", mats["root"][:, :, :2], x) + mats["root"][:, :, 2].T[:, :, None] * np.log(np.exp(u).sum(axis=0))
    assert np.allclose(got["m"], np.exp(u) / np.exp(u).sum(axis=0)) and np.allclose(got["root"], np.exp(v) / np.exp(v).sum(axis=0))
    steep = {name: m * 1e4 for name, m in mats.items()}  # beyond the doubles
    assert all(np.allclose(s.sum(axis=0), 1) for s in ne._evaluate(tree, x, None, steep, {}).values())


def test_every_product_has_its_own_task(spark):
    for n in (1, 7, 72):
        keys = ds._placed(spark, n)
        placed = spark.createDataFrame([(k,) for k in keys], "_task int").repartition(n, "_task").select(F.spark_partition_id()).distinct()
        assert len(set(keys)) == n and placed.count() == n


def test_a_count_likelihood_prepares_its_rows_once(monkeypatch):
    loglik = me.poisson_draws("y", 0.5)
    u, y = np.random.default_rng(2).normal(size=(3, 5, 4)), np.array([0.0, 1.0, 4.0, 2.0])
    with monkeypatch.context() as m:
        seen = [0]
        m.setattr(math, "lgamma", lambda v, plain=math.lgamma: (seen.__setitem__(0, seen[0] + 1), plain(v))[1])
        of = loglik({"y": y})
        got = [of(u.copy()) for _ in range(3)]
    want = (y * u * 0.5 - np.exp(u * 0.5) - np.array([math.lgamma(v + 1) for v in y])).sum(axis=0)
    assert seen[0] == 4 and all(np.allclose(g, want) for g in got)
