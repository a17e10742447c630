"""Design assembly and statistical screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpanel.operators import aggregate as ag
from gridpanel.operators import design as de
from gridpanel.operators import screens as sc
from gridpanel.queries.base import Tables, query
from gridpanel.queries.spatial import CLASSES, SHARES
from gridpanel.session import written

COVS = ["x0", "x1", "x2", "x3"]
GROUPS = ["g0", "g1", "g2", "g3", "g4"]


def wide_lattice(t: Tables):
    sums = [F.sum(F.when(F.col("class") == c, F.col("area")).otherwise(0.0)).alias(c) for c in CLASSES]
    wide = t.lattice.groupBy("slice", "ix", "iy").agg(F.sum("area").alias("total"), *sums)
    return wide.withColumn("g", F.concat(F.lit("r"), (F.col("ix") % 5).cast("string")))


@query(
    "m1_recipe_replay", "lattice", dbl="log1p_total " + " ".join(f"focal_{c}" for c in CLASSES) + " focal_NODATA",
    sql=f"""WITH {SHARES}, tot AS (SELECT slice, ix, iy, sum(area) AS a FROM lattice GROUP BY 1, 2, 3), w AS (SELECT slice, ix, iy, """
    + ", ".join(f"coalesce(sum(CASE WHEN n_neighbours = 8 AND class = '{c}' THEN s / 8 END), 0.0) AS focal_{c}" for c in CLASSES)
    + """ FROM pos LEFT JOIN foc USING (slice, ix, iy) LEFT JOIN cnt USING (slice, ix, iy) GROUP BY 1, 2, 3) SELECT slice, ix, iy, 'r' || (ix % 5) AS group_known, 1.0::DOUBLE AS intercept,
    ln(1 + a) AS log1p_total, w.* EXCLUDE (slice, ix, iy), greatest(0.0, 1 - (""" + " + ".join(f"focal_{c}" for c in CLASSES) + ")) AS focal_NODATA FROM w JOIN tot USING (slice, ix, iy)",
)
def _(t: Tables):
    design, recipe = de.build_recipe(
        wide_lattice(t), key=["slice", "ix", "iy"], features=["log1p_total"], classes=CLASSES, lattice=("ix", "iy"), slices=["slice"],
        group="g", transforms=[{"fn": "log1p", "cols": ["total"], "prefix": "log1p_"}], add_nodata=True,
    )
    return design.select("slice", "ix", "iy", "group_known", *recipe.col_order)


@query(
    "m2_recipe_check", "design", dbl="max_d mean_d frac_gt01 p99_d",
    sql="""WITH d AS (SELECT false AS focal, abs(x1 - x1 * 1.001) AS d FROM design UNION ALL SELECT false, 0.0 FROM design UNION ALL SELECT true, abs(x3 - x3 * 1.02) FROM design)
        SELECT focal, max(d) AS max_d, avg(d) AS mean_d, avg(CASE WHEN d > 0.01 THEN 1.0 ELSE 0 END) AS frac_gt01, quantile_cont(d, 0.99) AS p99_d FROM d GROUP BY 1""",
)
def _(t: Tables):
    a = t.design.withColumnRenamed("x3", "focal_x3")
    b = a.withColumn("x1", F.col("x1") * 1.001).withColumn("focal_x3", F.col("focal_x3") * 1.02)
    return de.recipe_check(a, b, ["row"], ["x1", "x2", "focal_x3"])


@query(
    "m3_count_recipe", dbl="log1p_o_totalprice offset",
    sql="""SELECT o_orderkey, 1.0::DOUBLE AS intercept, CAST(year(o_orderdate) AS DOUBLE) AS time, ln(1 + o_totalprice) AS log1p_o_totalprice, CASE WHEN year(o_orderdate) = 1996 THEN 1.0 ELSE 0.0 END::DOUBLE AS year_1996,
        CASE WHEN year(o_orderdate) = 1997 THEN 1.0 ELSE 0.0 END::DOUBLE AS year_1997, ln(greatest(o_custkey / 100.0::DOUBLE, 0.5)) AS "offset" FROM orders""",
)
def _(t: Tables):
    src = t.orders.withColumn("yr", F.year("o_orderdate")).withColumn("exposure", F.col("o_custkey") / 100)
    steps = [{"fn": "log1p", "cols": ["o_totalprice"], "prefix": "log1p_"}]
    return de.apply_count_recipe(src, ["o_orderkey"], ["log1p_o_totalprice"], steps, "yr", [1996, 1997], "exposure", 0.5, add_time=True)


@query(
    "m4_group_means", "design", dbl="GM_x1 GM_x2 GM_x3_x_x1 GM_x3_x_x2",
    sql="""WITH m AS (SELECT grp, avg(x1) AS a, avg(x2) AS b FROM design GROUP BY 1), s AS (SELECT grp, (a - avg(a) OVER ()) / stddev_samp(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_samp(b) OVER () AS b FROM m)
        SELECT "row", a AS GM_x1, b AS GM_x2, x3 * a AS GM_x3_x_x1, x3 * b AS GM_x3_x_x2 FROM design JOIN s USING (grp)""",
)
def _(t: Tables):
    spec = de.group_mean_design(t.design, "grp", ["x0", "x1", "x2"], ["intercept", "x3"])
    return de.apply_group_mean_design(spec, t.design).select("row", *spec.names)


@query("m5_level_contrast", "design", dbl="y_level y_response", sql='SELECT "row", (x1 + x2 + x3) / 3 AS y_level, x3 - x1 AS y_response FROM design')
def _(t: Tables):
    return de.level_contrast(t.design, ["x1", "x2", "x3"], "x1", "x3", "y").select("row", "y_level", "y_response")


@query(
    "m6_display_sds", "design", dbl="sd_x",
    sql="SELECT 'x0' AS cov, 1.0::DOUBLE AS sd_x UNION ALL SELECT 'x1', stddev_samp(x1) FROM design UNION ALL SELECT 'x2', stddev_samp(x2) FROM design UNION ALL SELECT 'x3', 1.0",
)
def _(t: Tables):
    return de.display_sds(t.design, COVS)


@query(
    "m6_standardise", "design", dbl="x1 x2 x3",
    sql='SELECT "row", (x1 - avg(x1) OVER ()) / stddev_samp(x1) OVER () AS x1, (x2 - avg(x2) OVER ()) / stddev_samp(x2) OVER () AS x2, x3, x0 FROM design',
)
def _(t: Tables):
    return de.standardise(t.design, COVS).select("row", *COVS)


BLOCKROWS = """r AS (SELECT cell, sum(area) AS total, sum(CASE WHEN class IN ('PROMO', 'SMALL') THEN area ELSE 0 END) / sum(area) AS part FROM lu GROUP BY 1),
    l AS (SELECT 'focal' AS block, 6 AS n_cols, CASE WHEN total > 290 THEN 0.5 ELSE 1.0 END AS rs FROM r UNION ALL SELECT 'S', 2, part FROM r)"""


@query(
    "m7_constant_sum_blocks", "lu", dbl="centre cv off_fraction",
    sql=f"""WITH {BLOCKROWS}, c AS (SELECT block, median(rs) AS centre FROM l WHERE rs > 1e-4 GROUP BY 1), m AS (SELECT block, median(abs(rs - centre)) AS mad FROM l JOIN c USING (block) WHERE rs > 1e-4 GROUP BY 1),
        o AS (SELECT block, CAST(n_cols AS INTEGER) AS n_cols, avg(CASE WHEN abs(rs - centre) > 0.01 THEN 1.0 ELSE 0 END) AS off_fraction FROM l JOIN c USING (block) GROUP BY 1, 2)
        SELECT block, n_cols, centre, 1.4826 * mad / greatest(abs(centre), 1e-8) AS cv, off_fraction, abs(centre - 1) < 0.05 AND 1.4826 * mad / greatest(abs(centre), 1e-8) < 0.05 AND off_fraction <= 0.02 AS accepted
        FROM c JOIN m USING (block) JOIN o USING (block)""",
)
def _(t: Tables):
    shares = ag.to_shares(t.lu, ["cell"], "class", "area")
    total = F.sum("area")
    scale = F.when(total > 290, 0.5).otherwise(1.0)
    cols = [(F.sum(F.when(F.col("class") == c, F.col("share")).otherwise(0.0)) * scale).alias(f"focal_{c}") for c in CLASSES]
    two = [F.sum(F.when(F.col("class") == c, F.col("share")).otherwise(0.0)).alias(f"S_s{i}") for i, c in enumerate(("PROMO", "SMALL"))]
    wide = shares.groupBy("cell").agg(*cols, *two)
    return sc.constant_sum_blocks(wide, [c for c in wide.columns if c != "cell"])


def _pr_sql(by: str) -> str:
    key = f"{by}, " if by else ""
    win = f"PARTITION BY {by}" if by else ""
    parts = [
        f"SELECT {key}'{c}' AS cov, count(*) AS n, stddev_samp({c}) AS sd, power(sum(d2), 2) / greatest(sum(d2 * d2), 1e-12) AS pr FROM "
        f"(SELECT *, power({c} - avg({c}) OVER ({win}), 2) AS d2 FROM design) {'GROUP BY ' + by if by else ''}"
        for c in COVS
    ]
    return f"SELECT *, CASE WHEN cov = 'x0' THEN 1.0 ELSE n / greatest(pr, 1) END AS factor FROM ({' UNION ALL '.join(parts)})"


@query("m8_participation_ratio", "design", dbl="sd pr:4 factor", sql=_pr_sql(""))
def _(t: Tables):
    return sc.participation_ratio(t.design, COVS)


@query("m8_group_support", "design", dbl="sd pr:4 factor", sql=_pr_sql("grp"))
def _(t: Tables):
    return sc.participation_ratio(t.design, COVS, ["grp"])


@query(
    "m9_support_screen", "design", dbl="pr:4",
    sql=f"""WITH p AS ({_pr_sql('')}) SELECT cov, pr, cov IN ('x2', 'x3') AS kept, CASE cov WHEN 'x0' THEN 'constant' WHEN 'x1' THEN 'duplicate' ELSE '' END AS reason FROM p
        UNION ALL SELECT 'x9', pr, true, '' FROM p WHERE cov = 'x1'""",
)
def _(t: Tables):
    return sc.support_screen(t.design.withColumn("x9", F.col("x1") * 2), [*COVS, "x9"])


SCREENED = """sd AS (SELECT *, x1 * 2 AS x5, CASE WHEN grp = 'g0' THEN 1.0 ELSE x2 * 1.5 END AS x6 FROM design)"""


def _screened(t: Tables):
    return t.design.withColumn("x5", F.col("x1") * 2).withColumn("x6", F.when(F.col("grp") == "g0", 1.0).otherwise(F.col("x2") * 1.5))


@query(
    "m10_identifiability_mask", "design",
    sql=f"""WITH {SCREENED} SELECT grp, 'x6' AS cov, 'no_variation' AS reason FROM sd GROUP BY 1 HAVING stddev_samp(x6) < 1e-8
        UNION ALL SELECT grp, CASE WHEN var_samp(x1) <= var_samp(x5) THEN 'x1' ELSE 'x5' END, 'collinear' FROM sd GROUP BY 1 HAVING abs(corr(x1, x5)) > 0.95
        UNION ALL SELECT grp, 'x2', 'collinear' FROM sd GROUP BY 1 HAVING stddev_samp(x6) > 1e-8 AND abs(corr(x2, x6)) > 0.95""",
)
def _(t: Tables):
    return sc.identifiability_mask(_screened(t), "grp", ["x1", "x2", "x3", "x5", "x6"])


@query(
    "m11_group_collinearity", "design", dbl="hit_fraction max_corr:7",
    sql=f"""WITH {SCREENED} SELECT 'x1' AS dropped, 'x5' AS kept, 1.0::DOUBLE AS hit_fraction, 1.0::DOUBLE AS max_corr, 'global' AS scope, 5 AS n_groups
        UNION ALL SELECT CASE WHEN (SELECT var_samp(x2) <= var_samp(x6) FROM sd) THEN 'x2' ELSE 'x6' END, CASE WHEN (SELECT var_samp(x2) <= var_samp(x6) FROM sd) THEN 'x6' ELSE 'x2' END, 0.8, 1.0, 'global', 4""",
)
def _(t: Tables):
    out = sc.group_collinearity(_screened(t), "grp", ["x1", "x2", "x3", "x5", "x6"])
    return out.withColumn("n_groups", F.size("groups")).drop("groups")


@query(
    "m12_presence_mask", "fits", dbl="n_effective:6 var_ratio",
    sql="""WITH m AS (SELECT sum(obs) / count(DISTINCT "row") AS mt FROM fits), g AS (SELECT class, var_samp(obs) AS vg FROM fits GROUP BY 1)
        SELECT grp, class, n, ne AS n_effective, vl / vg AS var_ratio, vl IS NULL OR vl < 1e-8 AS masked, np = 0 AS absent, ne < least(5, greatest(2, ceil(n * 0.01))) AS sparse
        FROM (SELECT grp, class, count(*) AS n, sum(obs) / max(mt) AS ne, var_samp(obs) AS vl, count(CASE WHEN obs > mt * 0.001 THEN 1 END) AS np FROM fits, m GROUP BY 1, 2) JOIN g USING (class)""",
)
def _(t: Tables):
    return sc.presence_mask(t.fits, "row", "grp", "class", "obs")


@query(
    "m13_separation_screen", "fits", dbl="lo_1 hi_1 lo_b hi_b overlap",
    sql="""WITH r AS (SELECT "row", grp, class, obs, x1, x2, sum(obs) OVER (PARTITION BY "row") AS t FROM fits), h AS (SELECT sum(t) / count(*) * 0.01 AS thr FROM r),
        s AS (SELECT grp, class, x1, x2, 'p' AS side FROM r, h WHERE obs > thr UNION ALL SELECT grp, class, x1, x2, 'b' FROM r, h WHERE t - obs > thr),
        l AS (SELECT grp, class, side, 'x1' AS cov, x1 AS x FROM s UNION ALL SELECT grp, class, side, 'x2', x2 FROM s),
        q AS (SELECT grp, class, cov, quantile_cont(x, 0.05) FILTER (side = 'p') AS lo_1, quantile_cont(x, 0.95) FILTER (side = 'p') AS hi_1, var_samp(x) FILTER (side = 'p') AS v1,
            quantile_cont(x, 0.05) FILTER (side = 'b') AS lo_b, quantile_cont(x, 0.95) FILTER (side = 'b') AS hi_b FROM l GROUP BY 1, 2, 3), n AS (SELECT grp, count(DISTINCT "row") AS n FROM r GROUP BY 1)
        SELECT grp, class, cov, lo_1, hi_1, lo_b, hi_b, CASE WHEN hi_1 IS NULL OR hi_b IS NULL THEN 0.0 ELSE greatest(0, (least(hi_1, hi_b) - greatest(lo_1, lo_b)) / (greatest(hi_1, hi_b) - least(lo_1, lo_b) + 1e-9)) END AS overlap,
        CASE WHEN hi_1 IS NULL OR hi_b IS NULL THEN true ELSE lo_1 >= hi_b OR lo_b >= hi_1 OR coalesce(v1, 0) < 1e-4 OR (hi_b < 1e-3 AND hi_1 > 0.05) OR (hi_1 < 1e-3 AND hi_b > 0.05) END AS flagged
        FROM q JOIN n USING (grp) WHERE n >= 10""",
)
def _(t: Tables):
    fits = written(t.fits.select("row", "grp", "class", "obs", "x1", "x2"))  # the screen reads it several times
    rows = fits.groupBy("row", "grp").agg(F.first("x1").alias("x1"), F.first("x2").alias("x2"))
    return sc.separation_screen(rows, fits.select("row", "class", "obs"), "row", "grp", ["x1", "x2"], "class", "obs")


@query(
    "m14_pair_moments", "design", dbl="cov corr",
    sql="SELECT grp, a, b, c AS cov, r AS corr FROM (" + " UNION ALL ".join(
        f"SELECT grp, '{a}' AS a, '{b}' AS b, covar_samp({a}, {b}) AS c, corr({a}, {b}) AS r FROM design GROUP BY 1" for a, b in (("x1", "x2"), ("x1", "x3"), ("x2", "x3"))
    ) + ")",
)
def _(t: Tables):
    return sc.pair_moments(t.design, ["x1", "x2", "x3"], "grp").where(F.col("a") != F.col("b")).select("grp", "a", "b", "cov", "corr")


@query(
    "m14_decorrelate", "design",
    sql="""SELECT unnest(['x1', 'x2', 'x3']) AS cov UNION ALL SELECT 'x8' FROM (SELECT abs(corr(x1, x1 + 0.1 * x3)) AS r FROM design) WHERE r < 0.9""",
)
def _(t: Tables):
    src = t.design.withColumn("x8", F.col("x1") + F.col("x3") * 0.1)
    kept = sc.decorrelate(src, ["x1", "x2", "x3", "x8"], 0.9, protect=["x1"])
    return t.spark.createDataFrame([(c,) for c in kept], "cov string")


@query(
    "m15_rank_guard", "design",
    sql="SELECT 'x7' AS cov, 'dependent' AS reason FROM design HAVING max(abs((x1 + x2) - x1 - x2)) < 1e-9 UNION ALL SELECT 'x8', 'constant'",
)
def _(t: Tables):
    src = t.design.withColumn("x7", F.col("x1") + F.col("x2")).withColumn("x8", F.lit(5.0))
    out = sc.rank_guard(src, ["x0", "x1", "x2", "x3", "x7", "x8"], intercept="x0")
    return t.spark.createDataFrame(sorted(out.items()), "cov string, reason string")


@query(
    "m16_inert_columns", "design", dbl="variance",
    sql=" UNION ALL ".join(f"SELECT '{c}' AS cov, var_samp({e}) AS variance, {'true' if c == 'x8' else 'false'} AS inert FROM design" for c, e in (("x0", "x0"), ("x1", "x1"), ("x8", "x1 * 0"))),
)
def _(t: Tables):
    return sc.inert_columns(t.design.withColumn("x8", F.col("x1") * 0), ["x0", "x1", "x8"])


ALT = """zc AS (SELECT f."row", f.x1, m.alt, sum(obs * m.f) AS z FROM fits f JOIN (VALUES ('A', 'left', 1.0), ('N', 'left', 1.0), ('R', 'right', 1.0)) m(class, alt, f) USING (class) GROUP BY 1, 2, 3),
    zz AS (SELECT "row", alt AS alternative, z / greatest(sum(z) OVER (PARTITION BY "row"), 1e-12) * x1 AS z FROM zc)"""


def alt_block(t: Tables):
    mapping = t.lineitem.select(F.col("l_returnflag").alias("class")).distinct()
    mapping = mapping.withColumn("alternative", F.when(F.col("class") == "R", "right").otherwise("left"))
    return de.alt_values(t.fits.select("row", "class", "obs", "x1"), ["row"], mapping, "class", "obs", "x1")


@query("m17_alt_blocks", "fits", dbl="z", sql=f"WITH {ALT} SELECT \"row\", alternative, z / stddev_samp(z) OVER () AS z FROM zz")
def _(t: Tables):
    z = alt_block(t)
    return de.alt_apply_scale(z, de.alt_scale(z, "shared"))


@query("m17_alt_scale_per_class", "fits", dbl="z_scale", sql=f"WITH {ALT} SELECT alternative, stddev_samp(z) AS z_scale FROM zz GROUP BY 1")
def _(t: Tables):
    return de.alt_scale(alt_block(t), "per_class")


@query(
    "m20_coordinates", dbl="coord_x coord_y",
    sql="""SELECT o_orderkey, (o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER () AS coord_x, (o_custkey - avg(o_custkey) OVER ()) / stddev_samp(o_custkey) OVER () AS coord_y FROM orders""",
)
def _(t: Tables):
    return de.add_coordinates(t.orders, "o_totalprice", "o_custkey").select("o_orderkey", "coord_x", "coord_y")


@query("m21_log_odds", "lu", dbl="log_odds", sql="SELECT class, sum(area) + 1 AS smoothed, ln((sum(area) + 1) / max(sum(area) + 1) OVER ()) AS log_odds FROM lu GROUP BY 1")
def _(t: Tables):
    return de.empirical_log_odds(t.lu, "class", "area")


@query("m22_nest_paths", sql="""SELECT DISTINCT p_type || '_' || split_part(p_name, ' ', 2) || '_' || split_part(p_name, ' ', 1) AS class, p_type || '/' || p_type || '_' || split_part(p_name, ' ', 2) AS path FROM part""")
def _(t: Tables):
    words = F.split("p_name", " ")
    names = t.part.select(F.concat_ws("_", "p_type", F.get(words, F.lit(1)), F.get(words, F.lit(0))).alias("class")).distinct()
    # the class list is a vocabulary; the tree over it is a small driver-side object
    paths = de.nest_paths(sorted(r["class"] for r in names.collect()), "AUTO")
    return t.spark.createDataFrame([(c, "/".join(p)) for c, p in paths.items()], "class string, path string")


@query("m22_paths_from_mapping", sql="SELECT p_partkey AS class, CASE WHEN p_size > 25 THEN p_type || '/' || p_brand ELSE p_type END AS path FROM part")
def _(t: Tables):
    src = t.part.withColumn("lower_level", F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(" "))
    out = de.paths_from_mapping(src, "p_partkey", ["p_type", "lower_level"])
    return out.select("class", F.array_join("path", "/").alias("path"))


TREE = {"ECONOMY": ["cheap"], "PROMO": ["cheap"], "LARGE": ["sized"], "MEDIUM": ["sized"], "SMALL": ["sized"], "STANDARD": []}


@query(
    "m23_node_shares", "lu", dbl="share",
    sql="""WITH e AS (SELECT cell, area, CASE WHEN class IN ('ECONOMY', 'PROMO') THEN 'cheap' WHEN class = 'STANDARD' THEN 'STANDARD' ELSE 'sized' END AS top, class FROM lu),
        s AS (SELECT cell, 'root' AS node, top AS child, sum(area) AS a FROM e GROUP BY 1, 2, 3 UNION ALL SELECT cell, top, class, sum(area) FROM e WHERE top <> 'STANDARD' GROUP BY 1, 2, 3),
        n AS (SELECT node, count(DISTINCT cell) AS n_rows FROM s GROUP BY 1)
        SELECT node, cell, child, a / sum(a) OVER (PARTITION BY cell, node) AS share, n_rows, n_rows < 12000 AS even FROM s JOIN n USING (node)""",
)
def _(t: Tables):
    return de.node_shares(t.lu, ["cell"], "class", "area", TREE, 12000)
