"""Lattice neighbourhoods and spatial hold-outs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpanel.operators import focal as fo
from gridpanel.operators import split as sp
from gridpanel.queries.base import Tables, query

CLASSES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]

SHARES = """sh AS (SELECT slice, ix, iy, class, area / sum(area) OVER (PARTITION BY slice, ix, iy) AS share FROM lattice),
    pos AS (SELECT DISTINCT slice, ix, iy FROM lattice),
    nb AS (SELECT a.slice, a.ix, a.iy, b.ix AS jx, b.iy AS jy FROM pos a JOIN pos b ON a.slice = b.slice AND b.ix BETWEEN a.ix - 1 AND a.ix + 1
        AND b.iy BETWEEN a.iy - 1 AND a.iy + 1 AND NOT (a.ix = b.ix AND a.iy = b.iy)),
    cnt AS (SELECT slice, ix, iy, count(*) AS n_neighbours FROM nb GROUP BY 1, 2, 3),
    foc AS (SELECT nb.slice, nb.ix, nb.iy, class, sum(share) AS s FROM nb JOIN sh ON sh.slice = nb.slice AND sh.ix = nb.jx AND sh.iy = nb.jy GROUP BY 1, 2, 3, 4)"""


@query(
    "n1_focal_mean", "lattice", dbl="focal",
    sql=f"WITH {SHARES} SELECT slice, ix, iy, class, s / n_neighbours AS focal, n_neighbours FROM foc JOIN cnt USING (slice, ix, iy)",
)
def _(t: Tables):
    return fo.focal_mean(t.lattice, ["slice"], "ix", "iy", "class", "area", complete_only=False)


@query(
    "n1_focal_complete_wide", "lattice", dbl=" ".join(f"focal_{c}" for c in CLASSES) + " focal_NODATA",
    sql=f"WITH {SHARES}, w AS (SELECT slice, ix, iy, "
    + ", ".join(f"coalesce(sum(CASE WHEN n_neighbours = 8 AND class = '{c}' THEN s / 8 END), 0.0) AS focal_{c}" for c in CLASSES)
    + " FROM pos LEFT JOIN foc USING (slice, ix, iy) LEFT JOIN cnt USING (slice, ix, iy) GROUP BY 1, 2, 3) SELECT *, greatest(0.0, 1 - ("
    + " + ".join(f"focal_{c}" for c in CLASSES) + ")) AS focal_NODATA FROM w",
)
def _(t: Tables):
    focal = fo.focal_mean(t.lattice, ["slice"], "ix", "iy", "class", "area", complete_only=True)
    cells = t.lattice.select("slice", "ix", "iy").distinct()
    return fo.focal_wide(focal, cells, ["slice", "ix", "iy"], "class", CLASSES, nodata=True)


VALUES = "v AS (SELECT slice, ix, iy, sum(area) AS v FROM lattice GROUP BY 1, 2, 3)"


def _values(t: Tables):
    return t.lattice.groupBy("slice", "ix", "iy").agg(F.sum("area").alias("v"))


def _window_sql(agg: str, reach: int, weight: str, centre: bool, out: str) -> str:
    no_centre = "" if centre else "AND NOT (a.ix = b.ix AND a.iy = b.iy)"
    return f"""WITH {VALUES}, p AS (SELECT a.slice, a.ix, a.iy, b.v, {weight} AS w FROM v a JOIN v b ON a.slice = b.slice AND b.ix BETWEEN a.ix - {reach} AND a.ix + {reach}
        AND b.iy BETWEEN a.iy - {reach} AND a.iy + {reach} {no_centre}) SELECT slice, ix, iy, {out} FROM v LEFT JOIN (SELECT slice, ix, iy, {agg} AS r FROM p GROUP BY 1, 2, 3) USING (slice, ix, iy)"""


@query("n2_window_mean", "lattice", dbl="m", sql=_window_sql("sum(v) / 8.0", 1, "1.0", False, "r AS m"))
def _(t: Tables):
    return fo.focal_window(_values(t), ["slice"], "ix", "iy", "v", fo.window_weights(3), "mean", out="m")


DIST = "sqrt((a.ix - b.ix) ** 2 + (a.iy - b.iy) ** 2)"


@query("n2_window_exponential", "lattice", dbl="m:7", sql=_window_sql("sum(v * w)", 2, f"exp(-0.7 * {DIST})", True, "r AS m"))
def _(t: Tables):
    return fo.focal_window(_values(t), ["slice"], "ix", "iy", "v", fo.window_weights(5, "exponential", 0.7, True), "sum", out="m")


@query("n2_window_inverse", "lattice", dbl="m:7", sql=_window_sql("sum(v * w)", 1, f"1 / ({DIST} + 1e-6) ** 2", False, "r AS m"))
def _(t: Tables):
    return fo.focal_window(_values(t), ["slice"], "ix", "iy", "v", fo.window_weights(3, "inverse", 2.0), "sum", out="m")


@query("n2_window_max", "lattice", sql=_window_sql("max(v)", 1, "1.0", False, "r AS m"))
def _(t: Tables):
    return fo.focal_window(_values(t), ["slice"], "ix", "iy", "v", fo.window_weights(3), "max", out="m")


@query("n2_window_min_filled", "lattice", sql=_window_sql("CASE WHEN count(*) < 8 THEN least(0.0, min(v)) ELSE min(v) END", 1, "1.0", False, "coalesce(r, 0.0) AS m"))
def _(t: Tables):
    return fo.focal_window(_values(t), ["slice"], "ix", "iy", "v", fo.window_weights(3), "min", fill=0.0, out="m")


@query("n2_window_median", "lattice", sql=_window_sql("median(v)", 1, "1.0", True, "r AS m"))
def _(t: Tables):
    return fo.focal_window(_values(t), ["slice"], "ix", "iy", "v", fo.window_weights(3, include_center=True), "median", out="m")


@query(
    "n2_window_modal", "lattice",
    sql=f"""WITH {VALUES}, p AS (SELECT a.slice, a.ix, a.iy, floor(b.v / 10) AS k, count(*) AS n FROM v a JOIN v b ON a.slice = b.slice AND b.ix BETWEEN a.ix - 1 AND a.ix + 1
        AND b.iy BETWEEN a.iy - 1 AND a.iy + 1 GROUP BY 1, 2, 3, 4) SELECT slice, ix, iy, arg_min(k, (-n, k)) AS m FROM p GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    src = _values(t).withColumn("v", F.floor(F.col("v") / 10).cast("double"))
    return fo.focal_window(src, ["slice"], "ix", "iy", "v", fo.window_weights(3, include_center=True), "modal", out="m")


@query(
    "n3_nodata_share", "lattice", dbl="nodata",
    sql=f"WITH {SHARES} SELECT slice, ix, iy, greatest(0.0, 1 - sum(s) / 8) AS nodata FROM foc GROUP BY 1, 2, 3",
)
def _(t: Tables):
    focal = fo.focal_mean(t.lattice, ["slice"], "ix", "iy", "class", "area", complete_only=False)
    parts = focal.groupBy("slice", "ix", "iy").agg(F.sum(F.col("focal") * F.col("n_neighbours") / 8).alias("_f"))
    return parts.select("slice", "ix", "iy", fo.nodata_share(F.col("_f")).alias("nodata"))


@query(
    "n4_infer_resolution",
    sql="""SELECT min(g) AS res FROM (SELECT lead(v) OVER (ORDER BY v) - v AS g FROM (SELECT DISTINCT l_partkey * 25.0::DOUBLE AS v FROM lineitem)
        UNION ALL SELECT lead(v) OVER (ORDER BY v) - v FROM (SELECT DISTINCT (l_orderkey % 40) * 50.0::DOUBLE AS v FROM lineitem)) WHERE g > 0""",
)
def _(t: Tables):
    pts = t.lineitem.select((F.col("l_partkey") * 25.0).alias("x"), ((F.col("l_orderkey") % 40) * 50.0).alias("y"))
    return fo.infer_resolution(pts, ["x", "y"])


@query(
    "n5_lattice_tiles",
    sql="""SELECT (l_partkey // 15) || '_' || ((l_orderkey % 40) // 15) AS tile, count(*) AS n FROM lineitem GROUP BY 1""",
)
def _(t: Tables):
    pts = t.lineitem.select((F.col("l_partkey") * 25.0).alias("x"), ((F.col("l_orderkey") % 40) * 25.0).alias("y"))
    ix, iy = fo.lattice_index("x", "y", 25.0)
    tiled = pts.withColumn("ix", ix).withColumn("iy", iy)
    return tiled.groupBy(fo.tile_key("ix", "iy", 15).alias("tile")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "n6_buffer_ring", "lattice",
    sql="""WITH p AS (SELECT DISTINCT ix, iy FROM lattice), s AS (SELECT DISTINCT ix, iy FROM lattice WHERE area > 120)
        SELECT ix, iy FROM p WHERE (ix, iy) NOT IN (SELECT (ix, iy) FROM s) AND EXISTS (SELECT 1 FROM s WHERE abs(s.ix - p.ix) <= 2 AND abs(s.iy - p.iy) <= 2)""",
)
def _(t: Tables):
    cells = t.lattice.select("ix", "iy").distinct()
    return fo.buffer_ring(cells, t.lattice.where(F.col("area") > 120).select("ix", "iy"), "ix", "iy", 2)


ERFC = """(t * exp(-x * x - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807
    + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))))"""


@query(
    "n7_morans_i", "lattice", dbl="moran_i:8 expected variance:12 p_value:6",
    sql=f"""WITH o AS (SELECT row_number() OVER () AS i, CAST(ix AS DOUBLE) AS x, CAST(iy AS DOUBLE) AS y, sum(area) AS area FROM lattice GROUP BY slice, ix, iy),
        z AS (SELECT i, x, y, area - avg(area) OVER () AS z FROM o),
        e AS (SELECT a.i, b.i AS j, a.z AS zi, b.z AS zj FROM z a JOIN z b ON a.i <> b.i AND b.x BETWEEN a.x - 1 AND a.x + 1 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 2.25),
        k AS (SELECT i, count(*) AS k FROM e GROUP BY 1),
        w AS (SELECT e.*, 1.0 / ki.k AS wi, 1.0 / kj.k AS wj FROM e JOIN k ki ON ki.i = e.i JOIN k kj ON kj.i = e.j),
        r AS (SELECT i, sum(wj) AS colsum FROM w GROUP BY 1),
        s AS (SELECT (SELECT count(*) FROM z) AS n_obs, (SELECT count(*) FROM k) AS n, (SELECT sum(wi * zi * zj) FROM w) AS num, (SELECT sum(z * z) FROM z) AS m2, (SELECT sum(z ** 4) FROM z) AS m4,
            (SELECT sum((wi + wj) ** 2) / 2 FROM w) AS s1, (SELECT sum((1 + colsum) ** 2) FROM r) AS s2),
        u AS (SELECT *, num / m2 AS moran_i, -1.0 / (n - 1) AS expected, n * m4 / (m2 * m2) AS kk FROM s),
        v AS (SELECT *, (n * (s1 * (n * n - 3.0 * n + 3) - n * s2 + 3.0 * n * n) - kk * (s1 * (n * n - 1.0 * n) - 2.0 * n * s2 + 6.0 * n * n)) / ((n - 1.0) * (n - 2) * (n - 3) * n * n) - expected ** 2 AS variance FROM u),
        q AS (SELECT *, abs((moran_i - expected) / sqrt(variance)) / sqrt(2.0) AS x, (moran_i - expected) AS d FROM v), y AS (SELECT *, 1 / (1 + 0.5 * x) AS t FROM q)
        SELECT n_obs, n_obs - n AS n_isolated, moran_i, expected, variance, CASE WHEN d >= 0 THEN {ERFC} / 2 ELSE 1 - {ERFC} / 2 END AS p_value FROM y""",
)
def _(t: Tables):
    obs = _values(t).select(F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"), "v")
    return fo.morans_i(obs, "x", "y", "v", 1.5)


@query(
    "n8_tvd_map", "fits", dbl="tvd",
    sql="""WITH r AS (SELECT "row", x1, x2, 0.5 * sum(abs(pred - obs)) AS tvd FROM fits GROUP BY 1, 2, 3), b AS (SELECT min(x1) AS a0, max(x1) AS a1, min("row") AS b0, max("row") AS b1 FROM r)
        SELECT CAST(greatest(least(ceil((x1 - a0) / ((a1 - a0) / 20)), 20), 1) AS INTEGER) AS bx, CAST(greatest(least(ceil(("row" - b0) / ((b1 - b0) / 20.0::DOUBLE)), 20), 1) AS INTEGER) AS "by",
        avg(tvd) AS tvd, count(*) AS n FROM r, b GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def _(t: Tables):
    from gridpanel.operators.metrics import row_scores

    rows = row_scores(t.fits, ["row", "x1"], "obs", "pred")
    return fo.tvd_map(rows, "x1", "row", "tvd", side=20)


@query(
    "n9_route_focal", "lattice", dbl="focal",
    sql=f"""WITH {SHARES} SELECT slice, ix, iy, CASE WHEN class IN ('ECONOMY', 'PROMO') THEN 'cheap_tot' WHEN class IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'sized_tot' ELSE class END AS class,
        sum(s / n_neighbours) AS focal FROM foc JOIN cnt USING (slice, ix, iy) GROUP BY 1, 2, 3, 4""",
)
def _(t: Tables):
    focal = fo.focal_mean(t.lattice, ["slice"], "ix", "iy", "class", "area", complete_only=False).drop("n_neighbours")
    child = F.when(F.col("class").isin("ECONOMY", "PROMO"), "cheap").when(F.col("class").isin("SMALL", "MEDIUM", "LARGE"), "sized")
    parents = t.part.select(F.col("p_type").alias("class")).distinct().withColumn("child", child).where(F.col("child").isNotNull())
    return fo.route_focal(focal, ["slice", "ix", "iy"], "class", "focal", parents)


@query(
    "n10_previous_state", "lattice", dbl="prev_PROMO prev_SMALL",
    sql="""WITH s AS (SELECT slice, ix, iy, sum(CASE WHEN class = 'PROMO' THEN area ELSE 0 END) / sum(area) AS p, sum(CASE WHEN class = 'SMALL' THEN area ELSE 0 END) / sum(area) AS q FROM lattice GROUP BY 1, 2, 3)
        SELECT a.slice, a.ix, a.iy, b.p AS prev_PROMO, b.q AS prev_SMALL FROM s a LEFT JOIN s b ON a.ix = b.ix AND a.iy = b.iy AND b.slice = a.slice - 1""",
)
def _(t: Tables):
    from gridpanel.operators.aggregate import to_shares
    from gridpanel.operators.windows import lagged_state

    sh = to_shares(t.lattice, ["slice", "ix", "iy"], "class", "area")
    wide = sh.groupBy("slice", "ix", "iy").agg(*[F.sum(F.when(F.col("class") == c, F.col("share")).otherwise(0.0)).alias(c) for c in ("PROMO", "SMALL")])
    return lagged_state(wide, ["ix", "iy"], "slice", ["PROMO", "SMALL"], 1).drop("PROMO", "SMALL")


# ---- splits ----------------------------------------------------------------------------------------------------

HASH = "CAST('0x' || substr(md5(concat_ws('|', '{seed}', {cols})), 1, 13) AS BIGINT)"


def _h(seed: int, *cols: str) -> str:
    return HASH.format(seed=seed, cols=", ".join(f"CAST({c} AS VARCHAR)" for c in cols))


@query(
    "t1_split_random",
    sql=f"SELECT o_orderkey, row_number() OVER (ORDER BY {_h(7, 'o_orderkey')}, o_orderkey) <= round_even(0.2 * (SELECT count(*) FROM orders), 0) AS test FROM orders",
)
def _(t: Tables):
    return sp.split_random(t.orders.select("o_orderkey"), ["o_orderkey"], 0.2, 7)


@query(
    "t2_split_stratified",
    sql=f"""SELECT o_orderkey, k, row_number() OVER (PARTITION BY k ORDER BY {_h(11, 'o_orderkey')}, o_orderkey) <= least(count(*) OVER (PARTITION BY k) - 1,
        greatest(0, round_even(0.25 * count(*) OVER (PARTITION BY k), 0))) AS test FROM (SELECT o_orderkey, o_custkey % 50 AS k FROM orders)""",
)
def _(t: Tables):
    src = t.orders.select("o_orderkey", (F.col("o_custkey") % 50).alias("k"))
    return sp.split_stratified(src, ["o_orderkey"], "k", 0.25, 11)


POINTS = """pts AS (SELECT o_orderkey AS id, o_custkey // 10 AS ix, o_orderkey % 150 AS iy, 'g' || (o_custkey % 7) AS g FROM orders),
    tl AS (SELECT *, (ix // 15) || '_' || (iy // 15) AS tile FROM pts)"""
BLOCKS = f"""tg AS (SELECT tile, g, count(*) AS n, {_h(5, 'tile')} AS h FROM tl GROUP BY tile, g),
    gs AS (SELECT g, sum(n) AS tot FROM tg GROUP BY 1),
    tc AS (SELECT t.tile, t.h, list(coalesce(tg.n, 0) ORDER BY gs.g) AS c FROM (SELECT DISTINCT tile, h FROM tg) t CROSS JOIN gs
        LEFT JOIN tg ON tg.tile = t.tile AND tg.g = gs.g GROUP BY 1, 2),
    seq AS (SELECT *, row_number() OVER (ORDER BY h, tile) AS i FROM tc),
    walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS tile, CAST(0 AS HUGEINT) AS h, false AS ok, (SELECT list(CAST(tot AS HUGEINT) ORDER BY g) FROM gs) AS lft, CAST(0 AS HUGEINT) AS n_rows
        UNION ALL SELECT i, tile, h, ok, CASE WHEN ok THEN nxt ELSE lft END, n_rows FROM (
            SELECT *, list_bool_and([x[2] = 0 OR x[1] >= 30 FOR x IN [[nxt[k], c[k]] FOR k IN range(1, len(c) + 1)]]) AS ok FROM (
                SELECT s.i, s.tile, CAST(s.h AS HUGEINT) AS h, w.lft, s.c, [w.lft[k] - s.c[k] FOR k IN range(1, len(s.c) + 1)] AS nxt, CAST(list_sum(s.c) AS HUGEINT) AS n_rows FROM walk w JOIN seq s ON s.i = w.i + 1))),
    good AS (SELECT tile, h, n_rows FROM walk WHERE ok),
    pick AS (SELECT tile, n_rows, sum(n_rows) OVER (ORDER BY h, tile ROWS UNBOUNDED PRECEDING) - n_rows AS before FROM good)"""


def _points(t: Tables):
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.floor(F.col("o_custkey") / 10).alias("ix"), (F.col("o_orderkey") % 150).alias("iy"),
        F.concat(F.lit("g"), (F.col("o_custkey") % 7).cast("string")).alias("g"),
    )


@query(
    "t3_split_blocks",
    sql=f"""WITH RECURSIVE {POINTS}, {BLOCKS}, tk AS (SELECT tile FROM pick WHERE before < round_even(0.2 * (SELECT count(*) FROM pts), 0))
        SELECT id, tile, tile IN (SELECT tile FROM tk) AS test FROM tl""",
)
def _(t: Tables):
    return sp.split_blocks(_points(t), "ix", "iy", "g", 0.2, 5).select("id", "tile", "test")


HYBRID = f"""{POINTS}, {BLOCKS}, tk AS (SELECT tile FROM pick WHERE before < round_even(0.1 * (SELECT count(*) FROM pts), 0)),
    bc AS (SELECT DISTINCT ix, iy FROM tl WHERE tile IN (SELECT tile FROM tk)),
    pc AS (SELECT DISTINCT ix, iy, tile FROM tl),
    zn AS (SELECT ix, iy, CASE WHEN tile IN (SELECT tile FROM tk) THEN 'test_block' WHEN EXISTS (SELECT 1 FROM bc WHERE abs(bc.ix - pc.ix) <= 1 AND abs(bc.iy - pc.iy) <= 1) THEN 'buffer' END AS z FROM pc),
    pl AS (SELECT id, ix, iy, g, z FROM tl JOIN zn USING (ix, iy)),
    fr AS (SELECT least(0.9, round_even(0.1 * (SELECT count(*) FROM pts), 0) / (SELECT count(*) FROM pl WHERE z IS NULL)) AS f),
    rk AS (SELECT *, row_number() OVER (PARTITION BY g, z IS NULL ORDER BY {_h(6, 'id')}, id) AS r, count(*) OVER (PARTITION BY g, z IS NULL) AS n FROM pl),
    role AS (SELECT id, ix, iy, g, CASE WHEN z IS NOT NULL THEN z WHEN r <= least(n - 1, greatest(0, round_even((SELECT f FROM fr) * n, 0))) THEN 'test_random' ELSE 'train' END AS role FROM rk)"""


@query("t4_spatial_split", sql=f"WITH RECURSIVE {HYBRID} SELECT * FROM role")
def _(t: Tables):
    return sp.spatial_split(_points(t), ["id"], "ix", "iy", "g", 0.2, seed=5)


@query(
    "t4_split_summary", dbl="fraction",
    sql=f"""WITH RECURSIVE {HYBRID} SELECT role, count(*) AS n, count(*) / (SELECT count(*) FROM role)::DOUBLE AS fraction,
        CAST((SELECT count(*) FROM (SELECT g FROM role GROUP BY g HAVING NOT bool_or(role = 'train'))) AS BIGINT) AS groups_missing_from_train FROM role GROUP BY 1""",
)
def _(t: Tables):
    return sp.split_summary(sp.spatial_split(_points(t), ["id"], "ix", "iy", "g", 0.2, seed=5), "g")


@query("t5_subsample", sql=f"SELECT o_orderkey FROM orders ORDER BY {_h(3, 'o_orderkey')}, o_orderkey LIMIT 1000")
def _(t: Tables):
    return sp.subsample(t.orders.select("o_orderkey"), ["o_orderkey"], 1000, 3)


@query(
    "t6_thin", "draws", dbl="value",
    sql="SELECT param, chain, iter, value FROM (SELECT *, max(iter) OVER (PARTITION BY param, chain) AS n FROM draws) WHERE (iter - 1) % greatest(1, CAST(ceil(n / 10.0) AS BIGINT)) = 0",
)
def _(t: Tables):
    return sp.thin(t.draws.select("param", "chain", "iter", "value"), ["param", "chain"], "iter", 10)
