"""Scans, class mapping, joins, aggregates, windows and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpanel.functions import scalar
from gridpanel.operators import aggregate as ag
from gridpanel.operators import classes as cl
from gridpanel.operators import joins as jn
from gridpanel.operators import windows as wn
from gridpanel.queries.base import Tables, query
from gridpanel.sources.readers import SourceEntry, normalise_source, project, read_flagged_table
from gridpanel.sources.sinks import raster_table

CLASSES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
YEARS = list(range(1995, 2002))


# ---- sources ---------------------------------------------------------------------------------------------------


@query("s1_projected_scan", sql="SELECT l_orderkey AS cell, l_partkey AS code, l_quantity AS area, l_extendedprice FROM lineitem")
def _(t: Tables):
    return project(t.lineitem, ["l_orderkey", "l_partkey"], [r"^l_(quantity|extended)"], {"l_orderkey": "cell", "l_partkey": "code", "l_quantity": "area"})


@query("s2_full_scan", sql="SELECT * FROM supplier")
def _(t: Tables):
    return t.supplier


@query(
    "s4_flagged_table", dbl="value:2",
    sql="""SELECT event_type, CAST(user_id AS VARCHAR) AS geo, CAST(y AS INTEGER) AS year,
        sum(CASE WHEN b = y THEN value END) AS value
        FROM (SELECT *, CASE WHEN day(ts) <= 10 THEN 2001 WHEN day(ts) <= 20 THEN 2002 ELSE 2003 END AS b FROM events)
        CROSS JOIN (VALUES (2001), (2002), (2003)) k(y) GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    day = F.dayofmonth("ts")
    bucket = F.when(day <= 10, 2001).when(day <= 20, 2002).otherwise(2003)
    sums = t.events.groupBy("event_type", "user_id").agg(*[F.sum(F.when(bucket == y, F.col("value"))).alias(f"_{y}") for y in (2001, 2002, 2003)])
    key = F.concat_ws(",", "event_type", F.col("user_id").cast("string")).alias("event_type,geo\\TIME_PERIOD")
    cell = {y: F.coalesce(F.concat(F.round(f"_{y}", 2).cast("string"), F.lit(" p")), F.lit(":")).alias(str(y)) for y in (2001, 2002, 2003)}
    return read_flagged_table(sums.select(key, *cell.values()))


@query("s6_registered_source", sql="SELECT l_orderkey AS join_id, l_partkey AS code, l_quantity AS area FROM lineitem WHERE l_quantity > 0")
def _(t: Tables):
    return normalise_source(t.lineitem, SourceEntry("lineitem", "l_orderkey", "l_partkey", "l_quantity"))


@query(
    "s10_raster_table", "lattice",
    sql="""SELECT slice, ix, iy, sum(area) AS total, arg_min(class, (-area, class)) AS dominant, count(*) AS n_classes
        FROM lattice GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    return raster_table(t.lattice, ["ix", "iy"], "class", "area", ["slice"])


# ---- class mapping ---------------------------------------------------------------------------------------------


@query("p1_map_classes", sql="""SELECT l_orderkey AS cell, p_type AS class, sum(l_quantity) AS area FROM lineitem
    LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def _(t: Tables):
    src = t.lineitem.select(F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("code"), F.col("l_quantity").alias("area"))
    lookup = t.part.select(F.col("p_partkey").alias("code"), F.col("p_type").alias("class"))
    return ag.sum_area(cl.map_classes(src, lookup, "code", "class"), ["cell", "class"])


@query(
    "p2_compose_class",
    sql="""SELECT p_partkey, CASE WHEN j = '' THEN 'NODATA' WHEN regexp_matches(d, '^[A-Za-z]') THEN d ELSE 'X' || d END AS model_class FROM (
        SELECT *, regexp_replace(j, '[^A-Za-z0-9._]', '.', 'g') AS d FROM (SELECT p_partkey,
        concat_ws('_', nullif(trim(CASE WHEN p_size > 40 THEN ' ' ELSE p_type END), ''), nullif(trim(CASE WHEN p_size > 30 THEN '' ELSE p_name END), ''),
        nullif(CASE WHEN p_size > 45 THEN '' ELSE p_brand END, '')) AS j FROM part))""",
)
def _(t: Tables):
    p = t.part.select(
        "p_partkey", F.when(F.col("p_size") > 40, " ").otherwise(F.col("p_type")).alias("a"),
        F.when(F.col("p_size") > 30, "").otherwise(F.col("p_name")).alias("b"), F.when(F.col("p_size") > 45, "").otherwise(F.col("p_brand")).alias("c"),
    )
    return cl.compose_class(p, ["a", "b", "c"]).select("p_partkey", "model_class")


@query(
    "p3_suffix_classes",
    sql="""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'widget') AND NOT regexp_matches(replace(p_type, '_', ''), 'O$')
        THEN p_type || '_O' ELSE p_type END AS model_class FROM part""",
)
def _(t: Tables):
    return cl.suffix_classes(t.part.withColumnRenamed("p_type", "model_class"), "p_name", rules=[("widget", "_O", "O$")]).select("p_partkey", "model_class")


@query(
    "p4_fold_classes", "lu",
    sql="""SELECT CASE WHEN class IN ('SMALL', 'LARGE') THEN 'no_choice' ELSE class END AS model_class, class AS focal_class, sum(area) AS area
        FROM lu GROUP BY 1, 2""",
)
def _(t: Tables):
    return ag.sum_area(cl.fold_classes(t.lu, ["SMALL", "LARGE"], cls="class").withColumnRenamed("class", "model_class"), ["model_class", "focal_class"])


SUBCLASS_SQL = """SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_type || '_' || p_brand END,
    CASE WHEN p_type = 'SMALL' THEN CASE WHEN contains(p_name, 'ring') THEN 'SMALL_ring' WHEN contains(p_name, 'widget') THEN 'SMALL_widget' END END,
    p_type) AS subclass FROM part"""


def _subclass(t: Tables):
    p = t.part.withColumn("mng", F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(""))
    return cl.derive_subclass(p, "p_type", "mng", "p_name", "SMALL", [("widget", "SMALL_widget"), ("ring", "SMALL_ring")])


@query("p5_derive_subclass", sql=SUBCLASS_SQL)
def _(t: Tables):
    return _subclass(t).select("p_partkey", "subclass")


@query("p6_diff_mapping", sql=f"SELECT p_partkey, p_type AS was, subclass AS now FROM part JOIN ({SUBCLASS_SQL}) USING (p_partkey) WHERE subclass <> p_type")
def _(t: Tables):
    old = t.part.withColumn("subclass", F.col("p_type"))
    return cl.diff_mapping(old, _subclass(t), "p_partkey", "subclass")


@query("p7_filter_labels", sql="SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(lower(coalesce(p_name, '')), 'red|blue')")
def _(t: Tables):
    return cl.filter_labels(t.part, "p_name", "red|blue").select("p_partkey", "p_name")


@query(
    "p8_filter_cells", "lu",
    sql="""SELECT cell, class, area FROM lu WHERE area > 0 AND cell IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
        AND cell IN (SELECT cell FROM lu GROUP BY 1 HAVING sum(area) >= 60)""",
)
def _(t: Tables):
    scope = t.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("cell"))
    return cl.filter_cells(t.lu, ["cell"], "area", 60.0, scope)


def _gappy(t: Tables):
    o = t.orders
    return o.select(
        "o_orderkey", F.col("o_totalprice").alias("area"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice") / 7).alias("a"),
        F.when(F.col("o_orderstatus") != "P", F.lit(1.5)).alias("b"),
    )


GAPPY = """(SELECT o_orderkey, o_totalprice AS area, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice / 7 END AS a,
    CASE WHEN o_orderstatus <> 'P' THEN 1.5 END AS b FROM orders)"""


@query("p9_complete_cases", sql=f"SELECT o_orderkey FROM {GAPPY} WHERE a IS NOT NULL AND b IS NOT NULL")
def _(t: Tables):
    return cl.complete_cases(_gappy(t), ["a", "b"], "area")[0].select("o_orderkey")


@query(
    "p9_missing_report", dbl="null_fraction area_lost:2",
    sql=f"""SELECT 'a' AS "column", avg(CASE WHEN a IS NULL THEN 1.0 ELSE 0.0 END) AS null_fraction, sum(CASE WHEN a IS NULL THEN area ELSE 0 END) AS area_lost FROM {GAPPY}
        UNION ALL SELECT 'b', avg(CASE WHEN b IS NULL THEN 1.0 ELSE 0.0 END), sum(CASE WHEN b IS NULL THEN area ELSE 0 END) FROM {GAPPY}""",
)
def _(t: Tables):
    return cl.complete_cases(_gappy(t), ["a", "b"], "area")[1]


@query("p10_clean_numeric", dbl="a:4 r:4", sql=f"SELECT o_orderkey, coalesce(a, 0.0) AS a, CASE WHEN coalesce(b, 0) = 0 THEN 0.0 ELSE area / b END AS r FROM {GAPPY}")
def _(t: Tables):
    df = _gappy(t).withColumn("r", F.when(F.col("b").isNull(), F.lit(float("nan"))).otherwise(F.col("area") / F.col("b")))
    df = cl.clean_numeric(cl.clean_numeric(df, ["r"], "nan_to_null"), ["r"], "nonfinite_to_zero")
    return cl.clean_numeric(df, ["a"], "null_to_zero").select("o_orderkey", "a", "r")


@query(
    "p11_drop_empty_classes", "cells",
    sql="""SELECT brand, class, sum(a) AS area FROM (SELECT brand, class, CASE WHEN class IN ('PROMO', 'SMALL') THEN 0.0 ELSE area END AS a FROM cells)
        WHERE class NOT IN ('PROMO', 'SMALL') GROUP BY 1, 2""",
)
def _(t: Tables):
    src = t.cells.withColumn("area", F.when(F.col("class").isin("PROMO", "SMALL"), 0.0).otherwise(F.col("area")))
    return cl.drop_empty_classes(src.groupBy("brand", "class").agg(F.sum("area").alias("area")), "class", "area")


def _vintages(t: Tables):
    return t.cells.groupBy("supp").agg(*[F.sum(F.when(F.col("year") == y, F.col("area")).otherwise(0.0)).alias(f"Pop_{y}") for y in (1996, 1998, 2000)])


@query("p12_select_vintage", "cells", sql="SELECT supp, sum(CASE WHEN year = 1998 THEN area ELSE 0 END) AS Pop FROM cells GROUP BY 1")
def _(t: Tables):
    return cl.select_vintage(_vintages(t), ["supp"], ["Pop"], 1997, "forward")


@query("p13_select_covariates", sql="SELECT c_custkey, c_acctbal FROM customer")
def _(t: Tables):
    return cl.select_covariates(t.customer, include=["c_acctbal", "c_mktsegment"], exclude=["c_mktsegment"], keep=["c_custkey"])


@query(
    "p14_default_outcome", "lu",
    sql="""SELECT cell, class, coalesce(area, 0.0) AS area FROM (SELECT DISTINCT cell FROM lu) CROSS JOIN (SELECT DISTINCT class FROM lu) LEFT JOIN lu USING (cell, class)""",
)
def _(t: Tables):
    return cl.default_outcome(t.lu, ["cell"], CLASSES, "class", "area")


# ---- joins -----------------------------------------------------------------------------------------------------


@query("j1_inner_join", "lu geo", sql="SELECT o_orderkey AS cell, o_orderstatus AS status, sum(area) AS area FROM lu JOIN orders ON cell = o_orderkey GROUP BY 1, 2")
def _(t: Tables):
    o = t.orders.select(F.col("o_orderkey").alias("cell"), F.col("o_orderstatus").alias("status"))
    return ag.sum_area(t.lu.groupBy("cell").agg(F.sum("area").alias("area")).join(o, "cell"), ["cell", "status"])


@query(
    "j2_left_multikey", "panel",
    sql="""SELECT grp, year, p.class, p.area, q.area AS other FROM panel p LEFT JOIN (SELECT grp, year, class, area FROM panel WHERE class = 'PROMO') q USING (grp, year, class)""",
)
def _(t: Tables):
    side = t.panel.where(F.col("class") == "PROMO").select("grp", "year", "class", F.col("area").alias("other"))
    return t.panel.select("grp", "year", "class", "area").join(side, ["grp", "year", "class"], "left")


@query(
    "j3_full_outer_fold", "panel",
    sql="""SELECT grp, year, max(CASE WHEN class = 'PROMO' THEN area END) AS promo, max(CASE WHEN class = 'SMALL' THEN area END) AS small,
        max(CASE WHEN class = 'LARGE' AND year > 1997 THEN area END) AS large FROM panel WHERE class IN ('PROMO', 'SMALL') OR (class = 'LARGE' AND year > 1997) GROUP BY 1, 2""",
)
def _(t: Tables):
    one = {c: t.panel.where(F.col("class") == c).select("grp", "year", F.col("area").alias(c.lower())) for c in ("PROMO", "SMALL", "LARGE")}
    return jn.full_outer_fold([one["PROMO"], one["SMALL"], one["LARGE"].where(F.col("year") > 1997)], ["grp", "year"])


@query(
    "j4_right_outer",
    sql="""SELECT o_orderkey AS cell, coalesce(n, 0) AS n FROM (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) RIGHT JOIN orders ON l_orderkey = o_orderkey""",
)
def _(t: Tables):
    left = t.lineitem.where(F.col("l_returnflag") == "A").groupBy(F.col("l_orderkey").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return left.join(t.orders.select(F.col("o_orderkey").alias("cell")), "cell", "right").fillna(0, ["n"])


@query(
    "j5_fan_out", "cells geo", dbl="area",
    sql="""SELECT region, grp, class, sum(area * w) AS area FROM (SELECT supp, class, sum(area) AS area FROM cells GROUP BY 1, 2) JOIN
        (SELECT supp, grp, region, 0.75 AS w FROM geo UNION ALL SELECT supp, region, region, 0.25 FROM geo) USING (supp) GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    own = t.geo.select("supp", "grp", "region", F.lit(0.75).alias("w"))
    spill = t.geo.select("supp", F.col("region").alias("grp"), "region", F.lit(0.25).alias("w"))
    src = t.cells.groupBy("supp", "class").agg(F.sum("area").alias("area"))
    out = jn.expand_weighted(src, own.unionByName(spill), ["supp"], "area", "w", salts=4)
    return ag.sum_area(out, ["region", "grp", "class"])


@query("j6_semi_join", sql="SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1")
def _(t: Tables):
    keys = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).join(keys, "l_orderkey", "left_semi")


@query("j7_anti_join", sql="SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(t: Tables):
    return t.orders.select("o_orderkey", "o_totalprice").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query(
    "j8_expand_grid", "panel",
    sql="""SELECT n_name AS geo, y AS year, c AS species, coalesce(a, 0.0) AS area FROM nation CROSS JOIN (SELECT CAST(unnest(range(1995, 2002)) AS INTEGER) AS y)
        CROSS JOIN (SELECT unnest(['ECONOMY', 'PROMO']) AS c) LEFT JOIN (SELECT grp, year, class, area AS a FROM panel) ON grp = n_name AND year = y AND class = c""",
)
def _(t: Tables):
    grid = jn.expand_grid(t.nation.select(F.col("n_name").alias("geo")), year=YEARS, species=["ECONOMY", "PROMO"])
    side = t.panel.select(F.col("grp").alias("geo"), "year", F.col("class").alias("species"), "area")
    return grid.join(side, ["geo", "year", "species"], "left").fillna(0.0, ["area"])


def _yearly(t: Tables):
    """Yearly values per supplier nation for the as-of joins, as three survey vintages."""
    y = t.panel.where(F.col("year").isin(1995, 1998, 2001)).groupBy("grp", "year").agg(F.sum("area").alias("value"))
    return y.select("grp", F.col("year").alias("w"), "value")


YEARLY = "(SELECT grp, year AS w, sum(area) AS value FROM panel WHERE year IN (1995, 1998, 2001) GROUP BY 1, 2)"
ORDERS_BY_NATION = """(SELECT n_name AS grp, CAST(year(o_orderdate) AS INTEGER) AS "at", count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""


def _orders_by_nation(t: Tables):
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("grp"))
    return t.orders.join(c, "o_custkey").groupBy("grp", F.year("o_orderdate").alias("at")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "j9_latest_before", "panel", dbl="value",
    sql=f"""SELECT o.grp, o."at", o.n, y.w AS matched_w, y.value FROM {ORDERS_BY_NATION} o LEFT JOIN {YEARLY} y ON y.grp = o.grp AND y.w =
        (SELECT max(w) FROM {YEARLY} z WHERE z.grp = o.grp AND z.w <= o."at")""",
)
def _(t: Tables):
    return jn.latest_before(_orders_by_nation(t), _yearly(t), ["grp"], "at", "w", ["value"])


@query(
    "j10_nearest_vintage", "panel", dbl="value",
    sql=f"""SELECT grp, "at", n, w AS matched_w, value FROM (SELECT o.grp, o."at", o.n, y.w, y.value, row_number() OVER (PARTITION BY o.grp, o."at" ORDER BY abs(y.w - o."at"), y.w) AS rn
        FROM {ORDERS_BY_NATION} o LEFT JOIN {YEARLY} y ON y.grp = o.grp) WHERE rn = 1""",
)
def _(t: Tables):
    return jn.nearest_vintage(_orders_by_nation(t), _yearly(t), ["grp"], "at", "w", ["value"])


@query(
    "j11_lattice_range_join", "lattice",
    sql="""WITH p AS (SELECT slice, ix, iy, sum(area) AS v FROM lattice GROUP BY 1, 2, 3)
        SELECT a.slice, a.ix, a.iy, count(*) AS n_near, sum(b.v) AS near_area FROM p a JOIN p b ON a.slice = b.slice AND b.ix BETWEEN a.ix - 1 AND a.ix + 1
        AND b.iy BETWEEN a.iy - 1 AND a.iy + 1 AND NOT (a.ix = b.ix AND a.iy = b.iy) GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    pos = t.lattice.groupBy("slice", "ix", "iy").agg(F.sum("area").alias("v"))
    near = jn.offset_join(pos.select("slice", "ix", "iy"), pos, "ix", "iy", ["slice"])
    return near.groupBy("slice", "ix", "iy").agg(F.count(F.lit(1)).alias("n_near"), F.sum("v").alias("near_area"))


@query(
    "j12_distance_band", "lattice", dbl="mean_dist",
    sql="""WITH p AS (SELECT DISTINCT ix * 1000 + iy AS id, ix, iy FROM lattice)
        SELECT a.id AS id_a, count(*) AS n_near, avg(sqrt((a.ix - b.ix) ** 2 + (a.iy - b.iy) ** 2)) AS mean_dist FROM p a JOIN p b
        ON b.ix BETWEEN a.ix - 3 AND a.ix + 3 AND (a.ix - b.ix) ** 2 + (a.iy - b.iy) ** 2 <= 6.25 GROUP BY 1""",
)
def _(t: Tables):
    pts = t.lattice.select((F.col("ix") * 1000 + F.col("iy")).alias("id"), F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y")).distinct()
    return jn.distance_band(pts, "x", "y", "id", 2.5).groupBy("id_a").agg(F.count(F.lit(1)).alias("n_near"), F.avg("dist").alias("mean_dist"))


@query(
    "j13_lookup_fallback", dbl="bal:4",
    sql="""WITH g AS (SELECT n_nationkey, substr(r_name, 1, 2) || n_nationkey AS code, substr(r_name, 1, 2) AS pre FROM nation JOIN region ON n_regionkey = r_regionkey),
        tab AS (SELECT code AS k, avg(s_acctbal) AS v FROM supplier JOIN g ON s_nationkey = n_nationkey WHERE n_nationkey < 12 GROUP BY 1
        UNION ALL SELECT pre, avg(s_acctbal) FROM supplier JOIN g ON s_nationkey = n_nationkey WHERE pre IN ('AF', 'AM') GROUP BY 1)
        SELECT c_custkey, code AS geo, coalesce(e.v, p.v, (SELECT avg(v) FROM tab)) AS bal, CASE WHEN e.v IS NOT NULL THEN 'exact' WHEN p.v IS NOT NULL THEN 'prefix' ELSE 'mean' END AS rung
        FROM customer JOIN g ON c_nationkey = n_nationkey LEFT JOIN tab e ON e.k = code LEFT JOIN tab p ON p.k = substr(code, 1, 2)""",
)
def _(t: Tables):
    r = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    g = r.select("n_nationkey", F.concat(F.substring("r_name", 1, 2), F.col("n_nationkey").cast("string")).alias("geo"), F.substring("r_name", 1, 2).alias("pre"))
    s = t.supplier.join(g, F.col("s_nationkey") == F.col("n_nationkey"))
    exact = s.where(F.col("n_nationkey") < 12).groupBy("geo").agg(F.avg("s_acctbal").alias("bal"))
    coarse = s.where(F.col("pre").isin("AF", "AM")).groupBy(F.col("pre").alias("geo")).agg(F.avg("s_acctbal").alias("bal"))
    c = t.customer.join(g, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "geo")
    return jn.lookup_with_fallback(c, exact.unionByName(coarse), "geo", "bal")


@query(
    "j14_class_pairs", "panel",
    sql="""SELECT a.grp, a.year, a.class AS from_class, b.class AS to_class, b.area - a.area AS diff FROM panel a JOIN panel b USING (grp, year) WHERE a.class <> b.class""",
)
def _(t: Tables):
    return jn.class_pairs(t.panel, ["grp", "year"], "class", "area", CLASSES)


@query("j15_crosswalk_join", sql="SELECT p_partkey * 10 + 1 AS code, sum(l_quantity) AS area FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def _(t: Tables):
    src = t.lineitem.groupBy(F.col("l_partkey").alias("code")).agg(F.sum("l_quantity").alias("area"))
    xw = t.part.select(F.col("p_partkey").alias("src"), (F.col("p_partkey") * 10 + 1).alias("dst"))
    return jn.crosswalk_join(src, xw, "code", "src", "dst")


@query(
    "j16_rounded_coordinates",
    sql="""WITH r AS (SELECT round(l_extendedprice / 1e4) AS k, round(l_discount * 100) AS d, count(*) AS n FROM lineitem GROUP BY 1, 2)
        SELECT o_orderkey, n FROM orders LEFT JOIN r ON k = round(o_totalprice / 1e5) AND d = round(CAST(substr(o_orderpriority, 1, 1) AS DOUBLE))""",
)
def _(t: Tables):
    left = t.orders.select("o_orderkey", (F.col("o_totalprice") / 1e5).alias("x"), F.substring("o_orderpriority", 1, 1).cast("double").alias("y"))
    right = t.lineitem.groupBy(F.round(F.col("l_extendedprice") / 1e4).alias("x"), F.round(F.col("l_discount") * 100).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return jn.rounded_coordinate_join(left, right, ["x", "y"]).select("o_orderkey", "n")


# ---- aggregates ------------------------------------------------------------------------------------------------


@query("a1_group_sum", "panel", sql="SELECT grp, class, sum(area) AS area FROM panel GROUP BY 1, 2")
def _(t: Tables):
    return ag.sum_area(t.panel, ["grp", "class"])


@query("a2_wide_sum", sql="SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity, sum(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2", dbl="l_extendedprice:2")
def _(t: Tables):
    return ag.sum_columns(t.lineitem, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"])


@query("a3_mean_ignoring_null", sql=f"SELECT (o_orderkey % 100) AS k, avg(a) AS a FROM {GAPPY} GROUP BY 1", dbl="a:4")
def _(t: Tables):
    return _gappy(t).groupBy((F.col("o_orderkey") % 100).alias("k")).agg(F.avg("a").alias("a"))


@query(
    "a4_weighted_moments", "cells", dbl="wmean:4 wsum:2 wsd:3 flat_share",
    sql="""SELECT supp, sum(price * area) / sum(area) AS wmean, sum(price * area) AS wsum,
        sqrt(greatest(sum(area * (price - m) ** 2) / sum(area), 0)) AS wsd, sum(CASE WHEN discount < 0.03 THEN area ELSE 0 END) / sum(area) AS flat_share
        FROM cells JOIN (SELECT supp, sum(price * area) / sum(area) AS m FROM cells GROUP BY 1) USING (supp) GROUP BY 1""",
)
def _(t: Tables):
    w = F.col("area")
    return t.cells.groupBy("supp").agg(
        ag.weighted_mean(F.col("price"), w).alias("wmean"), ag.weighted_sum(F.col("price"), w).alias("wsum"),
        ag.weighted_sd(F.col("price"), w).alias("wsd"), ag.weighted_share(F.col("discount") < 0.03, w).alias("flat_share"),
    )


@query("a5_weighted_sum_nulls", dbl="wmean:4", sql=f"SELECT (o_orderkey % 50) AS k, sum(a * area) / sum(CASE WHEN a IS NOT NULL THEN area END) AS wmean FROM {GAPPY} GROUP BY 1")
def _(t: Tables):
    return _gappy(t).groupBy((F.col("o_orderkey") % 50).alias("k")).agg(ag.weighted_mean(F.col("a"), F.col("area")).alias("wmean"))


@query("a7_sample_variance", "cells", dbl="v:2", sql="SELECT class, year, var_samp(price) AS v FROM cells GROUP BY 1, 2")
def _(t: Tables):
    return t.cells.groupBy("class", "year").agg(F.var_samp("price").alias("v"))


@query(
    "a9_dominant", "cells",
    sql="SELECT supp, class AS top_class FROM (SELECT supp, class, row_number() OVER (PARTITION BY supp ORDER BY count(*) DESC, class) AS rn FROM cells GROUP BY 1, 2) WHERE rn = 1",
)
def _(t: Tables):
    return ag.dominant(t.cells, ["supp"], "class", "top_class")


@query(
    "a10_first_by_order",
    sql="""SELECT l_orderkey, l_linenumber, l_quantity, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1""",
)
def _(t: Tables):
    return ag.first_by(t.lineitem, ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], ["l_linenumber", "l_quantity", "l_partkey"])


@query(
    "a11_circular", dbl="aspect:4 circ_var",
    sql="""SELECT l_suppkey, CASE WHEN d < 0 THEN d + 360 ELSE d END AS aspect, 1 - sqrt(s * s + c * c) AS circ_var FROM (SELECT l_suppkey, s, c, degrees(atan2(s, c)) AS d FROM
        (SELECT l_suppkey, avg(sin(l_discount * 40)) AS s, avg(cos(l_discount * 40)) AS c FROM lineitem GROUP BY 1))""",
)
def _(t: Tables):
    mean, var = ag.circular(F.sin(F.col("l_discount") * 40), F.cos(F.col("l_discount") * 40))
    return t.lineitem.groupBy("l_suppkey").agg(mean.alias("aspect"), var.alias("circ_var"))


CATSHARE = "SELECT supp, brand, sum(area) AS area, sum(area) / sum(sum(area)) OVER (PARTITION BY supp) AS share FROM cells GROUP BY 1, 2"


@query("a12_category_shares", "cells", dbl="share", sql=CATSHARE)
def _(t: Tables):
    return ag.category_shares(t.cells, ["supp"], "brand", "area")


@query(
    "a13_reference_contrasts", "cells", dbl="TY_dev1 TY_dev2 TY_s0 TY_s1 TY_s2",
    sql="""SELECT supp, a AS TY_s0, b AS TY_s1, c AS TY_s2, b - a AS TY_dev1, c - a AS TY_dev2 FROM (SELECT supp, sum(CASE WHEN k = 0 THEN area ELSE 0 END) / sum(area) AS a,
        sum(CASE WHEN k = 1 THEN area ELSE 0 END) / sum(area) AS b, sum(CASE WHEN k = 2 THEN area ELSE 0 END) / sum(area) AS c FROM (SELECT *, length(class) % 3 AS k FROM cells) GROUP BY 1)""",
)
def _(t: Tables):
    src = t.cells.withColumn("k", F.length("class") % 3)
    shares = ag.category_shares(src, ["supp"], "k", "area")
    return ag.ref_diff(ag.pivot_shares(shares, ["supp"], "k", "share", [0, 1, 2], "TY"), "TY")


@query("a14_row_shares", "lu", dbl="share", sql="SELECT cell, class, area, area / sum(area) OVER (PARTITION BY cell) AS share FROM lu")
def _(t: Tables):
    return ag.to_shares(t.lu, ["cell"], "class", "area")


DIVERSITY = """WITH s AS (SELECT {k}, area / sum(area) OVER (PARTITION BY {k}) AS p FROM {src})
    SELECT {k}, count(*) AS richness, sum(-p * ln(p)) AS shannon, 1 - sum(p * p) AS simpson,
    CASE WHEN count(*) > 1 THEN sum(-p * ln(p)) / ln(count(*)) ELSE 0.0 END AS evenness FROM s GROUP BY {k}"""


@query("a15_diversity", "lu", dbl="shannon simpson evenness", sql=DIVERSITY.format(k="cell", src="lu"))
def _(t: Tables):
    return ag.diversity(ag.to_shares(t.lu, ["cell"], "class", "area"), ["cell"])


@query("flagship_nation_diversity", "panel", dbl="shannon simpson evenness", sql=DIVERSITY.format(k="grp, year", src="panel"))
def flagship(t: Tables):
    return ag.diversity(ag.to_shares(t.panel, ["grp", "year"], "class", "area"), ["grp", "year"])


@query("a16_distinct_counts", "cells", sql="SELECT class, count(DISTINCT cell) AS n_cells, count(DISTINCT code) AS n_codes FROM cells GROUP BY 1")
def _(t: Tables):
    return t.cells.groupBy("class").agg(F.countDistinct("cell").alias("n_cells"), F.countDistinct("code").alias("n_codes"))


@query("a17_conserved_totals", "panel", sql="SELECT sum(area) AS area FROM panel")
def _(t: Tables):
    before, after = t.lineitem.select(F.col("l_quantity").alias("area")), t.panel
    ag.assert_conserved(before, after, "area")
    ag.assert_unique(t.panel, ["grp", "year", "class"])
    ag.assert_shares(ag.to_shares(t.panel, ["grp", "year"], "class", "area"), ["grp", "year"], "share")
    return after.agg(F.sum("area").alias("area"))


@query(
    "a20_group_coverage", "cells geo", dbl="coverage",
    sql="""SELECT grp, coalesce(m, 0.0) AS modeled_area, o AS orig_area, coalesce(m, 0.0) / o AS coverage, NOT (coalesce(m, 0.0) / o < 0.15 OR coalesce(m, 0.0) < 2500) AS keep
        FROM (SELECT grp, sum(area) AS o FROM cells JOIN geo USING (supp) GROUP BY 1) LEFT JOIN (SELECT grp, sum(area) AS m FROM cells JOIN geo USING (supp) WHERE discount < 0.02 GROUP BY 1) USING (grp)""",
)
def _(t: Tables):
    frame = t.cells.join(t.geo, "supp")
    return ag.group_coverage(frame.where(F.col("discount") < 0.02), frame, "grp", "area", "area", min_area=2500.0)


@query(
    "a20_coverage_filter", "cells geo",
    sql="""WITH f AS (SELECT * FROM cells JOIN geo USING (supp)), m AS (SELECT grp, sum(area) AS m FROM f WHERE discount < 0.02 GROUP BY 1), o AS (SELECT grp, sum(area) AS o FROM f GROUP BY 1)
        SELECT grp, count(*) AS n FROM f WHERE discount < 0.02 AND grp IN (SELECT grp FROM o JOIN m USING (grp) WHERE m / o >= 0.15 AND m >= 2500) GROUP BY 1""",
)
def _(t: Tables):
    frame = t.cells.join(t.geo, "supp")
    kept = ag.coverage_filter(frame.where(F.col("discount") < 0.02), frame, "grp", "area", "area", min_area=2500.0)
    return kept.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


@query("a20_min_rows", "cells geo", sql="SELECT grp, count(*) AS n FROM cells JOIN geo USING (supp) GROUP BY 1 HAVING count(*) >= 2000")
def _(t: Tables):
    return ag.min_rows_filter(t.cells.join(t.geo, "supp"), "grp", 2000).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


@query("a21_area_report", "panel", sql="SELECT year, class, sum(area) AS total_area, min(area) AS min_area, max(area) AS max_area FROM panel GROUP BY ROLLUP (year, class)")
def _(t: Tables):
    return ag.area_report(t.panel, ["year", "class"], "area")


@query(
    "a22_cattle_shares", "panel", dbl="D O F",
    sql="""SELECT grp, year, d / tot AS D, o / tot AS O, CASE WHEN tot IS NOT NULL AND d IS NOT NULL AND o IS NOT NULL THEN greatest(tot - d - o, 0) / tot END AS F,
        CASE WHEN d IS NULL OR tot IS NULL THEN 'MISSING' ELSE 'reported' END AS src FROM (SELECT grp, year, sum(CASE WHEN class = 'STANDARD' THEN area END) AS tot,
        sum(CASE WHEN class = 'ECONOMY' THEN area END) AS d, sum(CASE WHEN class = 'PROMO' THEN area END) AS o FROM panel GROUP BY 1, 2)""",
)
def _(t: Tables):
    return ag.cattle_shares(t.panel, ["grp", "year"], "class", "area", "STANDARD", "ECONOMY", "PROMO")


RUMINANTS = """SELECT grp, year, ts + tg AS tot, em + sg AS n_d, CASE WHEN ed > 0 THEN ed ELSE greatest(ek - em, 0) END AS n_o,
    greatest(ts + tg - em - sg - CASE WHEN ed > 0 THEN ed ELSE greatest(ek - em, 0) END, 0) AS n_f FROM (SELECT grp, year,
    coalesce(sum(CASE WHEN class = 'STANDARD' THEN area END), 0) AS ts, coalesce(sum(CASE WHEN class = 'MEDIUM' THEN area END), 0) AS tg,
    coalesce(sum(CASE WHEN class = 'SMALL' THEN area END), 0) AS em, 0.0 AS ed, coalesce(sum(CASE WHEN class = 'LARGE' THEN area END), 0) AS ek,
    coalesce(sum(CASE WHEN class = 'PROMO' THEN area END), 0) AS sg FROM panel GROUP BY 1, 2)"""


@query("a22_ruminant_counts", "panel", sql=RUMINANTS)
def _(t: Tables):
    codes = {
        "sheep_total": "STANDARD", "goat_total": "MEDIUM", "milk_ewes": "SMALL", "meat_ewes": "none", "all_ewes": "LARGE",
        "she_goats": "none", "she_goats_a": "PROMO", "she_goats_b": "none",
    }
    return ag.small_ruminant_counts(t.panel, ["grp", "year"], "class", "area", codes)


@query(
    "a23_round_preference", dbl="value",
    sql="""SELECT user_id, arg_min(value, rk) AS value FROM (SELECT user_id, sum(value) AS value, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 END AS rk
        FROM events WHERE event_type IN ('purchase', 'signup', 'view') GROUP BY user_id, event_type) GROUP BY 1""",
)
def _(t: Tables):
    src = t.events.groupBy("user_id", "event_type").agg(F.sum("value").alias("value"))
    return ag.collapse_preference(src, ["user_id"], "event_type", ["purchase", "signup", "view"], "value")


@query("a24_to_heads", dbl="value:2", sql="SELECT event_id, CASE WHEN event_type = 'view' THEN 'THS_HD' ELSE 'NR' END AS unit, CASE WHEN event_type = 'view' THEN value * 1000 ELSE value END AS value FROM events")
def _(t: Tables):
    src = t.events.select("event_id", F.when(F.col("event_type") == "view", "THS_HD").otherwise("NR").alias("unit"), "value")
    return ag.to_heads(src, "unit", "value")


@query(
    "a25_organic_shares", "panel", dbl="organic_share",
    sql="""WITH o AS (SELECT grp AS geo, year + 12 AS y, sum(area) AS v FROM panel WHERE class = 'PROMO' GROUP BY 1, 2), t AS (SELECT grp AS geo, year + 12 AS y, sum(area) AS v FROM panel GROUP BY 1, 2),
        d AS (SELECT * FROM (SELECT DISTINCT geo FROM t) CROSS JOIN (SELECT CAST(unnest([2000, 2010, 2012, 2015]) AS INTEGER) AS year)),
        s AS (SELECT *, CASE WHEN year <= 2010 THEN 2012 ELSE (SELECT max(y) FROM o WHERE y <= year) END AS oy FROM d)
        SELECT s.geo, s.year, CASE WHEN year <= 2000 THEN 0.0 ELSE coalesce(o.v / t.v * CASE WHEN year <= 2010 THEN 0.85 ELSE 1 END, 0.0) END AS organic_share,
        CASE WHEN year <= 2000 THEN 'assumed_0' WHEN year <= 2010 THEN '2012_backcast' ELSE 'org_' || oy END AS src
        FROM s LEFT JOIN o ON o.geo = s.geo AND o.y = s.oy LEFT JOIN t ON t.geo = s.geo AND t.y = s.year""",
)
def _(t: Tables):
    p = t.panel.select(F.col("grp").alias("geo"), (F.col("year") + 12).alias("year"), "class", F.col("area").alias("value"))
    return ag.organic_shares(p.where(F.col("class") == "PROMO"), p, "geo", [2000, 2010, 2012, 2015])


@query(
    "a26_coverage_matrix", "panel",
    sql="""SELECT n_name AS geo, y AS year, c AS species, CASE WHEN a IS NULL THEN 'MISSING' ELSE 'panel' END AS prod_src, coalesce(a > 500, false) AS prod_ok
        FROM nation CROSS JOIN (SELECT CAST(unnest([1995, 1998, 2005]) AS INTEGER) AS y) CROSS JOIN (SELECT unnest(['ECONOMY', 'PROMO']) AS c)
        LEFT JOIN (SELECT grp, year, class, area AS a FROM panel) ON grp = n_name AND year = y AND class = c""",
)
def _(t: Tables):
    src = t.panel.select(F.col("grp").alias("geo"), "year", F.col("class").alias("species"), F.lit("panel").alias("src"), (F.col("area") > 500).alias("ok"))
    return ag.coverage_matrix(t.nation.select(F.col("n_name").alias("geo")), "geo", [1995, 1998, 2005], ["ECONOMY", "PROMO"], {"prod": src})


@query(
    "a27_rollup_region", "cells geo", dbl="log1p_area:5 price:3",
    sql="""SELECT substr(grp, 1, 8) AS region, ln(1 + sum(area)) AS log1p_area, sum(price * area) / sum(area) AS price FROM cells JOIN geo USING (supp) GROUP BY 1""",
)
def _(t: Tables):
    return ag.rollup_region(t.cells.join(t.geo.drop("region"), "supp"), "grp", 8, ["area"], ["price"], "area")


@query(
    "a28_composition_response", "panel",
    sql="""SELECT grp, n_d, n_o, greatest(tot - n_d - n_o, 0) AS n_f FROM (SELECT grp, sum(CASE WHEN class = 'STANDARD' THEN area END) AS tot, sum(CASE WHEN class = 'ECONOMY' THEN area END) AS n_d,
        sum(CASE WHEN class = 'PROMO' AND year = 1995 THEN area END) AS n_o FROM panel GROUP BY 1) WHERE n_d IS NOT NULL AND n_o IS NOT NULL AND tot > 0""",
)
def _(t: Tables):
    src = t.panel.where((F.col("class") != "PROMO") | (F.col("year") == 1995))
    return ag.composition_response(src, "grp", "class", "area", "STANDARD", "ECONOMY", "PROMO")


@query(
    "a29_proxy_response", "panel",
    sql="""SELECT grp, year, sum(CASE WHEN regexp_matches(class, 'O$') THEN area ELSE 0 END) AS n_org, sum(CASE WHEN NOT regexp_matches(class, 'O$') THEN area ELSE 0 END) AS n_conv
        FROM panel WHERE regexp_matches(class, '^(PROMO|SMALL|LARGE)') GROUP BY 1, 2""",
)
def _(t: Tables):
    return ag.proxy_response(t.panel, ["grp", "year"], "class", "area", "^(PROMO|SMALL|LARGE)", "O$")


@query(
    "a30_admin_panel", "cells geo", dbl="price:3 price_sd:2 discount_total:4 flat_share total_area_km2 lu_area_PROMO lu_area_SMALL",
    sql="""WITH f AS (SELECT * FROM cells JOIN geo USING (supp)), m AS (SELECT grp, year, sum(price * area) / sum(area) AS mu FROM f GROUP BY 1, 2)
        SELECT grp, year, max(mu) AS price, sum(discount * area) AS discount_total, sqrt(sum(area * (price - mu) ** 2) / sum(area)) AS price_sd,
        sum(CASE WHEN discount < 0.03 THEN area ELSE 0 END) / sum(area) AS flat_share, sum(area) AS total_area_km2,
        sum(CASE WHEN class = 'PROMO' THEN area ELSE 0 END) AS lu_area_PROMO, sum(CASE WHEN class = 'SMALL' THEN area ELSE 0 END) AS lu_area_SMALL FROM f JOIN m USING (grp, year) GROUP BY 1, 2""",
)
def _(t: Tables):
    f = t.cells.join(t.geo, "supp")
    return ag.admin_panel(
        f, f, ["grp", "year"], "area", ["price"], ["discount"], ["price"], {"flat_share": F.col("discount") < 0.03}, "class", "area", ["PROMO", "SMALL"]
    )


@query("a31_units_by_region", "panel", sql="SELECT region, class, year, sum(area) AS area FROM panel GROUP BY 1, 2, 3")
def _(t: Tables):
    return ag.sum_area(t.panel, ["region", "class", "year"])


# ---- windows ---------------------------------------------------------------------------------------------------


@query(
    "w1_top_by_count", "cells geo",
    sql="SELECT code, grp, n FROM (SELECT code, grp, count(*) AS n, row_number() OVER (PARTITION BY code ORDER BY count(*) DESC, grp) AS rn FROM cells JOIN geo USING (supp) GROUP BY 1, 2) WHERE rn = 1",
)
def _(t: Tables):
    return wn.top_by_count(t.cells.join(t.geo, "supp"), "code", "grp")


@query(
    "w2_prevalence_curve", "cells", dbl="share cum",
    sql="SELECT brand, s AS share, sum(s) OVER (ORDER BY s DESC, brand ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT brand, sum(area) / sum(sum(area)) OVER () AS s FROM cells GROUP BY 1)",
)
def _(t: Tables):
    return wn.prevalence_curve(t.cells, "brand", "area")


@query(
    "w3_latest_per_key",
    sql="SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1",
)
def _(t: Tables):
    return wn.latest_per_key(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@query("w4_group_share", sql="SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity / sum(l_quantity) OVER (PARTITION BY l_suppkey) AS share FROM lineitem", dbl="share:8")
def _(t: Tables):
    return wn.group_share(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity"), ["l_suppkey"], "l_quantity").drop("l_quantity")


@query(
    "w5_strongest_per_group", "panel",
    sql="SELECT grp, year, class, area FROM (SELECT *, row_number() OVER (PARTITION BY grp, year ORDER BY abs(area) DESC, class) AS rn FROM panel) WHERE rn = 1",
)
def _(t: Tables):
    return wn.strongest_per_group(t.panel, ["grp", "year"], "area", "class", ["class", "area"])


@query(
    "w6_lagged_state", "panel",
    sql="SELECT a.grp, a.class, a.year, a.area, b.area AS prev_area FROM panel a LEFT JOIN panel b ON a.grp = b.grp AND a.class = b.class AND b.year = a.year - 2",
)
def _(t: Tables):
    return wn.lagged_state(t.panel.drop("region"), ["grp", "class"], "year", ["area"], 2)


@query(
    "w7_quantile_bins",
    sql="""WITH c AS (SELECT list_distinct(quantile_cont(o_totalprice, [i / 12.0 FOR i IN range(13)])) AS cuts FROM orders)
        SELECT o_orderkey, CAST(greatest(len(list_filter(cuts, lambda v: v < o_totalprice)), 1) AS INTEGER) AS bin FROM orders, c""",
)
def _(t: Tables):
    return wn.quantile_bins(t.orders, "o_totalprice", 12).select("o_orderkey", "bin")


@query("w7_fixed_bins", sql="SELECT CAST(greatest(ceil(l_discount * 7 / 0.1), 1) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def _(t: Tables):
    return t.lineitem.groupBy(wn.fixed_bins(F.col("l_discount") * 7, 0.1).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


GRIDBIN = "CAST(greatest(least(ceil(({c} - {c}0) / (({c}1 - {c}0) / 44)), 44), 1) AS INTEGER)"


@query(
    "w8_grid_bins", dbl="v:2",
    sql=f"""WITH r AS (SELECT o_totalprice AS x, CAST(o_orderkey AS DOUBLE) AS y, CAST(o_custkey AS DOUBLE) AS v FROM orders), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM r)
        SELECT {GRIDBIN.format(c='x')} AS bx, {GRIDBIN.format(c='y')} AS "by", avg(v) AS v, count(*) AS n FROM r, b GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def _(t: Tables):
    src = t.orders.select(F.col("o_totalprice").alias("x"), F.col("o_orderkey").cast("double").alias("y"), F.col("o_custkey").cast("double").alias("v"))
    return wn.grid_bins(src, "x", "y", "v")


@query("w9_rarest", "cells", sql="SELECT brand, sum(area) AS area FROM cells GROUP BY 1 ORDER BY 2, 1 LIMIT 7")
def _(t: Tables):
    return wn.rarest(t.cells, "brand", "area", 7)


# ---- sorts, sets, reshaping ------------------------------------------------------------------------------------


@query("o1_head_by", "panel", sql="SELECT grp, area FROM (SELECT grp, sum(area) AS area FROM panel GROUP BY 1) ORDER BY area DESC, grp LIMIT 10")
def _(t: Tables):
    return wn.head_by(ag.sum_area(t.panel, ["grp"]), "area", "grp", 10)


@query("o3_strength_order", "panel", sql="SELECT class, max(area) - min(area) AS spread FROM panel GROUP BY 1")
def _(t: Tables):
    return wn.strength_order(t.panel, "class", "area")


@query(
    "u1_union_fill",
    sql="SELECT l_orderkey AS cell, l_quantity AS area, NULL::DOUBLE AS price FROM lineitem UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders",
)
def _(t: Tables):
    a = t.lineitem.select(F.col("l_orderkey").alias("cell"), F.col("l_quantity").alias("area"))
    b = t.orders.select(F.col("o_orderkey").alias("cell"), F.col("o_totalprice").alias("price"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u2_distinct", "cells", sql="SELECT DISTINCT class, brand, year FROM cells")
def _(t: Tables):
    return t.cells.select("class", "brand", "year").dropDuplicates()


@query(
    "u3_set_algebra", "cells",
    sql="""(SELECT brand, class FROM cells WHERE year = 1996 INTERSECT SELECT brand, class FROM cells WHERE year = 1999) EXCEPT SELECT brand, class FROM cells WHERE brand = 'Brand#2'""",
)
def _(t: Tables):
    c = t.cells.select("brand", "class", "year")
    pick = lambda y: c.where(F.col("year") == y).select("brand", "class")
    return pick(1996).intersect(pick(1999)).subtract(c.where(F.col("brand") == "Brand#2").select("brand", "class"))


PIVOT = ", ".join(f"sum(CASE WHEN class = '{c}' THEN area ELSE 0.0 END) AS {c}" for c in CLASSES)


@query("u4_pivot_fill", "lu", sql=f"SELECT cell, {PIVOT} FROM lu GROUP BY 1")
def _(t: Tables):
    return t.lu.groupBy("cell").pivot("class", CLASSES).agg(F.sum("area")).fillna(0.0, CLASSES)


@query("u5_unpivot", "cells", sql="SELECT supp, CAST(y AS INTEGER) AS year, sum(CASE WHEN year = y THEN area ELSE 0 END) AS pop FROM cells CROSS JOIN (VALUES (1996), (1998), (2000)) k(y) GROUP BY 1, 2")
def _(t: Tables):
    wide = _vintages(t)
    long = wide.unpivot(["supp"], [c for c in wide.columns if c.startswith("Pop_")], "name", "pop")
    return long.select("supp", F.regexp_extract("name", r"_(\d{4})$", 1).cast("int").alias("year"), "pop")


@query("u6_array_to_long", sql="SELECT vec_id, CAST(unnest(range(64)) AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings", dbl="v")
def _(t: Tables):
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


@query(
    "u7_explode_by_share", "cells geo", dbl="area",
    sql="""SELECT supp, k AS target, sum(area) * CASE k WHEN 'a' THEN 0.25 ELSE 0.75 END AS area FROM cells CROSS JOIN (VALUES ('a'), ('b')) v(k) GROUP BY 1, 2""",
)
def _(t: Tables):
    parts = F.explode(F.array(F.struct(F.lit("a").alias("k"), F.lit(0.25).alias("s")), F.struct(F.lit("b").alias("k"), F.lit(0.75).alias("s"))))
    base = ag.sum_area(t.cells, ["supp"]).withColumn("p", parts)
    return base.select("supp", F.col("p.k").alias("target"), (F.col("area") * F.col("p.s")).alias("area"))


# ---- scalar functions ------------------------------------------------------------------------------------------


@query(
    "f1_strings",
    sql="""SELECT p_partkey, upper(trim(p_name)) || '|' || substr(p_brand, 7) AS a, regexp_replace(p_name, '^\\S+ ', '') AS b, starts_with(p_name, 'red') AS c, lpad(CAST(p_size AS VARCHAR), 4, '0') AS d FROM part""",
)
def _(t: Tables):
    return t.part.select(
        "p_partkey", F.concat_ws("|", F.upper(F.trim("p_name")), F.expr("substring(p_brand, 7)")).alias("a"), F.regexp_replace("p_name", r"^\S+ ", "").alias("b"),
        F.startswith(F.col("p_name"), F.lit("red")).alias("c"), F.format_string("%04d", "p_size").alias("d"),
    )


@query("f2_tokens", sql="SELECT c_custkey, split_part(c_name, '#', 1) AS head, CAST(len(string_split(c_name, '#')) AS INTEGER) AS n FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", scalar.prefix_of(F.col("c_name"), 1, "#").alias("head"), F.size(scalar.tokens(F.col("c_name"), "#")).alias("n"))


@query(
    "f3_math", dbl="a b:5 c d e:4",
    sql="SELECT c_custkey, ln(1 + abs(c_acctbal)) AS a, sqrt(abs(c_acctbal)) AS b, atan2(c_acctbal, 1000.0) AS c, 1 / (1 + exp(-c_acctbal / 1000)) AS d, least(greatest(c_acctbal, 0), 5000) AS e FROM customer",
)
def _(t: Tables):
    x = F.col("c_acctbal")
    return t.customer.select(
        "c_custkey", F.log1p(F.abs(x)).alias("a"), F.sqrt(F.abs(x)).alias("b"), F.atan2(x, F.lit(1000.0)).alias("c"),
        scalar.logistic(x / 1000).alias("d"), scalar.clamp(x, 0.0, 5000.0).alias("e"),
    )


@query("f4_null_handling", dbl="r", sql=f"SELECT o_orderkey, coalesce(a / nullif(b, 0), -1.0) AS r FROM {GAPPY}")
def _(t: Tables):
    return _gappy(t).select("o_orderkey", scalar.safe_divide(F.col("a"), F.col("b"), -1.0).alias("r"))


@query(
    "f5_arrays", dbl="s m",
    sql="""SELECT vec_id, sum(v) AS s, max(v) AS m, CAST(arg_min(pos, (-v, pos)) AS BIGINT) AS top FROM (SELECT vec_id, unnest(range(1, 65)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1""",
)
def _(t: Tables):
    e = F.col("embedding").cast("array<double>")
    return t.embeddings.select(
        "vec_id", F.aggregate(e, F.lit(0.0), lambda a, v: a + v).alias("s"), F.array_max(e).alias("m"), F.array_position(e, F.array_max(e)).alias("top")
    )


@query("f6_years", sql="SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", F.year("o_orderdate").alias("year"))


@query("f7_named_transforms", dbl="log1p_o_totalprice o_custkey:5", sql="SELECT o_orderkey, ln(1 + o_totalprice) AS log1p_o_totalprice, sqrt(o_custkey) AS o_custkey FROM orders")
def _(t: Tables):
    steps = [{"fn": "log1p", "cols": ["o_totalprice", "absent"], "prefix": "log1p_"}, {"fn": "sqrt", "cols": ["o_custkey"]}]
    return scalar.apply_transforms(t.orders, steps).select("o_orderkey", "log1p_o_totalprice", "o_custkey")


@query("f9_lgamma", dbl="a b", sql="SELECT o_orderkey, lgamma(o_custkey + 0.3) AS a, lgamma(o_totalprice / 1e5) AS b FROM orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", scalar.lgamma(F.col("o_custkey") + 0.3).alias("a"), scalar.lgamma(F.col("o_totalprice") / 1e5).alias("b"))
