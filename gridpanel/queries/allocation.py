"""Area-conserving reallocation and livestock subtypes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpanel.functions.scalar import logistic
from gridpanel.operators import aggregate as ag
from gridpanel.operators import allocate as al
from gridpanel.queries.base import Tables, query

INDEX = {1995: 3.0, 1998: 5.2, 2001: 9.1}


@query(
    "r1_carve_flag", "lu", dbl="area",
    sql="""WITH f AS (SELECT o_orderkey AS cell, CASE WHEN o_orderpriority = '1-URGENT' THEN 0.4 ELSE 0.0 END AS f FROM orders),
        b AS (SELECT lu.cell, class, area, coalesce(f, 0.0) AS f, class IN ('ECONOMY', 'PROMO', 'SMALL') AS p FROM lu LEFT JOIN f USING (cell) WHERE class <> 'LARGE'),
        w AS (SELECT *, f * sum(CASE WHEN p THEN area ELSE 0 END) OVER (PARTITION BY cell) AS new, sum(CASE WHEN p THEN area ELSE 0 END) OVER (PARTITION BY cell) AS t FROM b)
        SELECT cell, class, CASE WHEN p THEN greatest(area - new * area / t, 0) ELSE area END AS area FROM w
        UNION ALL SELECT cell, 'LARGE', max(new) FROM w WHERE p GROUP BY 1 HAVING max(new) > 0""",
)
def _(t: Tables):
    flags = t.orders.select(F.col("o_orderkey").alias("cell"), F.when(F.col("o_orderpriority") == "1-URGENT", 0.4).otherwise(0.0).alias("f"))
    return al.carve_flag(t.lu, flags, "cell", "class", "area", "f", ["ECONOMY", "PROMO", "SMALL"], "LARGE")


def _organic_areas(t: Tables):
    o = t.orders
    return o.select(
        F.col("o_orderkey").alias("cell"), (F.col("o_totalprice") / 1e4).alias("cropland"), (F.col("o_custkey") % 17).cast("double").alias("livestock"),
        F.when(F.col("o_orderstatus") == "P", 3.0).otherwise(0.0).alias("mixed"), F.when(F.col("o_orderpriority") == "2-HIGH", 2.0).alias("all_systems"),
    )


@query(
    "r2_carve_sequential", "lu", dbl="area",
    sql=f"""WITH o AS (SELECT o_orderkey AS cell, o_totalprice / 1e4 AS cr, CAST(o_custkey % 17 AS DOUBLE) AS li, CASE WHEN o_orderstatus = 'P' THEN 3.0 ELSE 0.0 END AS mi,
        CASE WHEN o_orderpriority = '2-HIGH' THEN 2.0 END AS al FROM orders),
        b AS (SELECT lu.*, class IN ('ECONOMY', 'PROMO', 'SMALL') AS c, class IN ('LARGE') AS g, cr, li, mi, al FROM lu LEFT JOIN o USING (cell)),
        p AS (SELECT *, sum(CASE WHEN c THEN area ELSE 0 END) OVER (PARTITION BY cell) AS tc, sum(CASE WHEN g THEN area ELSE 0 END) OVER (PARTITION BY cell) AS tg FROM b),
        s AS (SELECT *, least(coalesce(cr / nullif(tc, 0), 0), 1) * {INDEX[1998] / INDEX[2001]} AS pc, least(coalesce(li / nullif(tg, 0), 0), 1) * {INDEX[1998] / INDEX[2001]} AS pl,
            least(coalesce(coalesce(mi, 0) / nullif(tc + tg, 0), 0), 1) * {INDEX[1998] / INDEX[2001]} AS pm, least(coalesce(coalesce(al, 0) / nullif(tc + tg, 0), 0), 1) * {INDEX[1998] / INDEX[2001]} AS pa FROM p),
        x AS (SELECT *, CASE WHEN c THEN area * pc WHEN g THEN area * pl ELSE 0 END AS a1 FROM s), y AS (SELECT *, greatest(area - a1, 0) * pm AS a2 FROM x),
        z AS (SELECT *, CASE WHEN c OR g THEN a1 + a2 + greatest(area - a1 - a2, 0) * pa ELSE 0 END AS m FROM y)
        SELECT cell, class, greatest(area - m, 0) AS area FROM z UNION ALL SELECT cell, class || '999', m FROM z WHERE c OR g""",
)
def _(t: Tables):
    weight = al.index_weight(1998, 2001, INDEX)
    return al.carve_sequential(t.lu, _organic_areas(t), "cell", "class", "area", ["ECONOMY", "PROMO"], ["SMALL"], ["LARGE"], weight)


@query(
    "r3_index_weight", "panel", dbl="area:7",
    sql=f"""SELECT year, sum(area) * least(1.0, CASE year WHEN 1995 THEN {INDEX[1995]} / {INDEX[2001]} WHEN 1998 THEN {INDEX[1998]} / {INDEX[2001]} ELSE 1.0 END) AS area FROM panel GROUP BY 1""",
)
def _(t: Tables):
    years = range(1995, 2002)
    weights = F.create_map(*[F.lit(v) for y in years for v in (y, al.index_weight(y, 2001, INDEX))])
    return t.panel.groupBy("year").agg(F.sum("area").alias("area")).withColumn("area", F.col("area") * weights[F.col("year")])


TYPED = """(SELECT l_orderkey AS cell, CASE WHEN l_returnflag = 'N' THEN 'perm' ELSE 'arable' END AS grp, l_returnflag || l_linestatus AS crop, sum(l_quantity) * 0.8 AS area
    FROM lineitem WHERE l_discount < 0.05 GROUP BY 1, 2, 3)"""


def _typed(t: Tables):
    li = t.lineitem.where(F.col("l_discount") < 0.05)
    grp = F.when(F.col("l_returnflag") == "N", "perm").otherwise("arable").alias("grp")
    out = li.groupBy(F.col("l_orderkey").alias("cell"), grp, F.concat("l_returnflag", "l_linestatus").alias("crop")).agg((F.sum("l_quantity") * 0.8).alias("area"))
    return out


SPLIT = f"""h AS (SELECT cell, CASE grp WHEN 'perm' THEN 'SMALL' ELSE 'PROMO' END AS class, crop, area AS hc, sum(area) OVER (PARTITION BY cell, grp) AS h FROM {TYPED}),
    sp AS (SELECT lu.cell, crop AS class, hc * least(1.0, area / h) AS area FROM lu JOIN h USING (cell, class)
    UNION ALL SELECT lu.cell, lu.class, CASE WHEN t.h IS NULL THEN area ELSE greatest(area - t.h, 0) END FROM lu LEFT JOIN (SELECT DISTINCT cell, class, h FROM h) t USING (cell, class)
        WHERE t.h IS NULL OR area - t.h > 1e-9)"""


def _split(t: Tables):
    return al.split_by_observed(t.lu, _typed(t), "cell", "class", "area", "grp", "crop", {"perm": "SMALL", "arable": "PROMO"})


@query("r4_split_by_observed", "lu", dbl="area", sql=f"WITH {SPLIT} SELECT * FROM sp")
def _(t: Tables):
    return _split(t)


@query(
    "r4_typed_fraction", "lu", dbl="typed_area:5 residual_area:5 typed_fraction",
    sql=f"""WITH {SPLIT} SELECT sum(CASE WHEN length(class) = 2 THEN area ELSE 0 END) AS typed_area, sum(CASE WHEN class IN ('SMALL', 'PROMO') THEN area ELSE 0 END) AS residual_area,
        sum(CASE WHEN length(class) = 2 THEN area ELSE 0 END) / sum(CASE WHEN length(class) = 2 OR class IN ('SMALL', 'PROMO') THEN area ELSE 0 END) AS typed_fraction FROM sp""",
)
def _(t: Tables):
    crops = [f + s for f in "ANR" for s in "FO"]
    return al.typed_fraction(_split(t), "class", "area", crops, ["SMALL", "PROMO"])


GEO_SQL = """gl AS (SELECT c_custkey, CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE substr(r_name, 1, 2) || n_nationkey END AS geo FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    cg AS (SELECT o_orderkey AS cell, geo FROM orders JOIN gl ON o_custkey = c_custkey),
    sv AS (SELECT substr(r_name, 1, 2) || n_nationkey AS geo, substr(r_name, 1, 2) AS pre, n_nationkey, l_returnflag AS target, sum(l_extendedprice) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3, 4),
    s1 AS (SELECT geo, target, v / sum(v) OVER (PARTITION BY geo) AS share FROM sv WHERE n_nationkey < 10
        UNION ALL SELECT pre, target, sum(v) / sum(sum(v)) OVER (PARTITION BY pre) FROM sv WHERE pre IN ('AF', 'EU') GROUP BY 1, 2),
    mn AS (SELECT target, avg(share) / sum(avg(share)) OVER () AS share FROM s1 GROUP BY 1)"""


def _shares(t: Tables):
    r = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    g = r.select("n_nationkey", F.substring("r_name", 1, 2).alias("pre"), F.concat(F.substring("r_name", 1, 2), F.col("n_nationkey").cast("string")).alias("geo"))
    s = t.supplier.join(g, F.col("s_nationkey") == F.col("n_nationkey"))
    v = t.lineitem.groupBy("l_suppkey", F.col("l_returnflag").alias("target")).agg(F.sum("l_extendedprice").alias("v"))
    v = v.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("geo", "pre", "n_nationkey", "target").agg(F.sum("v").alias("v"))
    own = ag.to_shares(v.where(F.col("n_nationkey") < 10), ["geo"], "target", "v").select("geo", "target", "share")
    pre = ag.to_shares(v.where(F.col("pre").isin("AF", "EU")), ["pre"], "target", "v").select(F.col("pre").alias("geo"), "target", "share")
    c = t.customer.join(g, F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("n_nationkey") % 6 != 5, F.col("geo")).alias("geo"))
    cells = t.orders.join(c, "o_custkey").select(F.col("o_orderkey").alias("cell"), "geo")
    return own.unionByName(pre).withColumn("group", F.lit("flags")), cells


RULES = [
    {"action": "rename", "from": "MEDIUM", "to": "LARGE"},
    {"action": "split", "from": "PROMO", "to": "flags"},
    {"action": "rename", "from": "A", "to": "ACTIVE"},
    {"action": "split", "from": "ABSENT", "to": "flags"},
]


@query(
    "r5_class_rules", "lu", dbl="area:7",
    sql=f"""WITH {GEO_SQL}, p AS (SELECT lu.cell, geo, class, area FROM lu LEFT JOIN cg USING (cell)),
        u AS (SELECT p.*, CASE WHEN geo IN (SELECT geo FROM s1) THEN geo WHEN substr(geo, 1, 2) IN (SELECT geo FROM s1) THEN substr(geo, 1, 2) END AS gu FROM p),
        o AS (SELECT cell, CASE class WHEN 'MEDIUM' THEN 'LARGE' ELSE class END AS class, area FROM u WHERE class <> 'PROMO'
            UNION ALL SELECT cell, CASE target WHEN 'A' THEN 'ACTIVE' ELSE target END, area * share FROM u JOIN s1 ON s1.geo = gu WHERE class = 'PROMO'
            UNION ALL SELECT cell, CASE target WHEN 'A' THEN 'ACTIVE' ELSE target END, area * share FROM u CROSS JOIN mn WHERE class = 'PROMO' AND gu IS NULL)
        SELECT cell, class, sum(area) AS area FROM o GROUP BY 1, 2""",
)
def _(t: Tables):
    shares, cells = _shares(t)
    return al.apply_class_rules(t.lu, RULES, shares, cells, "cell", "class", "area")


RAKE = """ob AS (SELECT cell AS pixel, supp AS zone, class, sum(area) AS area FROM cells GROUP BY 1, 2, 3),
    tg AS (SELECT supp AS zone, class, sum(price * discount) AS area FROM cells GROUP BY 1, 2),
    zo AS (SELECT zone, class, sum(area) AS obs FROM ob WHERE class <> 'LARGE' GROUP BY 1, 2),
    zz AS (SELECT zone, class, coalesce(obs, 0.0) AS obs, coalesce(area, 0.0) AS tgt FROM zo FULL JOIN (SELECT * FROM tg WHERE class <> 'LARGE') USING (zone, class)),
    z1 AS (SELECT *, sum(obs) OVER (PARTITION BY zone) AS a, sum(tgt) OVER (PARTITION BY zone) AS b FROM zz),
    z2 AS (SELECT zone, class, obs, CASE WHEN b > 0 THEN tgt * a / b ELSE obs END AS g FROM z1 WHERE a > 0),
    z3 AS (SELECT *, greatest(obs - g, 0) AS s, greatest(g - obs, 0) AS d FROM z2),
    z4 AS (SELECT *, sum(d) OVER (PARTITION BY zone) AS dd FROM z3),
    fl AS (SELECT zone, class AS f, class AS k, obs - s AS v FROM z4 UNION ALL SELECT x.zone, x.class, y.class, x.s * y.d / y.dd FROM z4 x JOIN z4 y USING (zone) WHERE x.s > 0 AND y.d > 0),
    fs AS (SELECT zone, f, k, v / sum(v) OVER (PARTITION BY zone, f) AS sh FROM fl WHERE v > 0),
    rk AS (SELECT pixel, zone, k AS class, sum(area * sh) AS area FROM ob JOIN fs USING (zone) WHERE ob.class = f GROUP BY 1, 2, 3 UNION ALL SELECT pixel, zone, class, area FROM ob WHERE class = 'LARGE')"""
RAKED = ["ECONOMY", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _rake(t: Tables):
    obs = t.cells.groupBy(F.col("cell").alias("pixel"), F.col("supp").alias("zone"), "class").agg(F.sum("area").alias("area"))
    targets = t.cells.groupBy(F.col("supp").alias("zone"), "class").agg(F.sum(F.col("price") * F.col("discount")).alias("area"))
    return obs, al.rake_to_targets(obs, targets, RAKED, "pixel", "zone", "class", "area")


@query("r6_rake_to_targets", "cells", dbl="area:7", sql=f"WITH {RAKE} SELECT * FROM rk")
def _(t: Tables):
    return _rake(t)[1]


@query("r6_zone_totals", "cells", dbl="area:5", sql=f"WITH {RAKE} SELECT zone, class, g AS area FROM z2 WHERE g > 1e-6 UNION ALL SELECT zone, class, sum(area) FROM ob WHERE class = 'LARGE' GROUP BY 1, 2")
def _(t: Tables):
    return _rake(t)[1].groupBy("zone", "class").agg(F.sum("area").alias("area")).where(F.col("area") > 1e-6)


@query(
    "r7_allocate_subtypes", "cells geo", dbl="total heads:7",
    sql="""WITH f AS (SELECT * FROM cells JOIN geo USING (supp)), tot AS (SELECT supp, grp, region, year, sum(area) AS total FROM f GROUP BY 1, 2, 3, 4),
        pr AS (SELECT region, year, sum(CASE WHEN class IN ('ECONOMY', 'LARGE') THEN area ELSE 0 END) / sum(area) AS D, sum(CASE WHEN class IN ('MEDIUM', 'PROMO') THEN area ELSE 0 END) / sum(area) AS O,
            sum(CASE WHEN class IN ('SMALL', 'STANDARD') THEN area ELSE 0 END) / sum(area) AS F FROM f GROUP BY 1, 2),
        dy AS (SELECT grp, year, sum(CASE WHEN class = 'ECONOMY' THEN area ELSE 0 END) / sum(area) AS ds FROM f WHERE year < 1999 GROUP BY 1, 2),
        og AS (SELECT region, year, sum(discount * area) / sum(area) AS os FROM f WHERE year > 1996 GROUP BY 1, 2),
        j AS (SELECT tot.*, coalesce(ds, D) AS d, O, F, coalesce(os, 0.0) AS os FROM tot LEFT JOIN pr USING (region, year) LEFT JOIN dy USING (grp, year) LEFT JOIN og USING (region, year)),
        k AS (SELECT *, (1 - d) * O / (O + F) AS o2 FROM j)
        SELECT supp, grp, region, year, total, s AS subtype, m AS system, total * CASE s WHEN 'D' THEN d WHEN 'O' THEN o2 ELSE 1 - d - o2 END * CASE m WHEN 'organic' THEN os ELSE 1 - os END AS heads
        FROM k CROSS JOIN (VALUES ('D'), ('O'), ('F')) a(s) CROSS JOIN (VALUES ('organic'), ('conventional')) b(m)""",
)
def _(t: Tables):
    f = t.cells.join(t.geo, "supp")
    cls, a = F.col("class"), F.col("area")
    part = lambda *names: (F.sum(F.when(cls.isin(*names), a).otherwise(0.0)) / F.sum(a))
    totals = f.groupBy("supp", "grp", "region", "year").agg(F.sum("area").alias("total"))
    production = f.groupBy("region", "year").agg(part("ECONOMY", "LARGE").alias("D"), part("MEDIUM", "PROMO").alias("O"), part("SMALL", "STANDARD").alias("F"))
    dairy = f.where(F.col("year") < 1999).groupBy("grp", "year").agg(part("ECONOMY").alias("dairy_share"))
    organic = f.where(F.col("year") > 1996).groupBy("region", "year").agg((F.sum(F.col("discount") * a) / F.sum(a)).alias("organic_share"))
    return al.allocate_subtypes(totals, production, dairy, organic, "region", "grp", ["year"])


@query(
    "r8_resolve_share", "panel", dbl="D O",
    sql="""WITH s AS (SELECT grp AS geo, region AS cluster, year, sum(CASE WHEN class IN ('ECONOMY', 'LARGE', 'SMALL') THEN area ELSE 0 END) / sum(area) AS D FROM panel GROUP BY 1, 2, 3),
        k AS (SELECT *, 1 - D AS O FROM s WHERE NOT (geo IN ('NATION_3', 'NATION_8') OR (cluster = 'ASIA') OR (geo = 'NATION_5' AND year BETWEEN 1996 AND 1999) OR year = 2001 AND cluster = 'EUROPE')),
        d AS (SELECT DISTINCT geo, cluster, year FROM s),
        nr AS (SELECT d.geo, d.year, k.year AS y, k.D, k.O, row_number() OVER (PARTITION BY d.geo, d.year ORDER BY abs(k.year - d.year), k.year) AS rn FROM d JOIN k ON k.geo = d.geo),
        c AS (SELECT cluster, year, avg(D) AS D, avg(O) AS O, count(*) AS n FROM k GROUP BY 1, 2), a AS (SELECT year, avg(D) AS D, avg(O) AS O, count(*) AS n FROM k GROUP BY 1)
        SELECT d.geo, d.year, d.cluster, CASE WHEN abs(y - d.year) <= 2 THEN nr.D ELSE coalesce(c.D, a.D) END AS D, CASE WHEN abs(y - d.year) <= 2 THEN nr.O ELSE coalesce(c.O, a.O) END AS O,
        CASE WHEN y = d.year THEN 'exact' WHEN abs(y - d.year) <= 2 THEN 'nearest_year' WHEN c.n > 0 THEN 'cluster' WHEN a.n > 0 THEN 'overall' ELSE 'unresolved' END AS rung,
        CASE WHEN abs(y - d.year) <= 2 THEN 1 WHEN c.n > 0 THEN c.n ELSE a.n END AS n_pool
        FROM d LEFT JOIN (SELECT * FROM nr WHERE rn = 1) nr USING (geo, year) LEFT JOIN c ON c.cluster = d.cluster AND c.year = d.year LEFT JOIN a ON a.year = d.year""",
)
def _(t: Tables):
    share = F.sum(F.when(F.col("class").isin("ECONOMY", "LARGE", "SMALL"), F.col("area")).otherwise(0.0)) / F.sum("area")
    s = t.panel.groupBy(F.col("grp").alias("geo"), F.col("region").alias("cluster"), "year").agg(share.alias("D")).withColumn("O", 1 - F.col("D"))
    gone = (
        F.col("geo").isin("NATION_3", "NATION_8") | (F.col("cluster") == "ASIA") | ((F.col("geo") == "NATION_5") & F.col("year").between(1996, 1999))
        | ((F.col("year") == 2001) & (F.col("cluster") == "EUROPE"))
    )
    return al.resolve_share(s.select("geo", "cluster", "year"), s.where(~gone), "geo", "year", "cluster", ["D", "O"])


@query(
    "r9_allocate_by_weights", "cells geo", dbl="weight heads:5",
    sql="""WITH f AS (SELECT * FROM cells JOIN geo USING (supp)), x AS (SELECT supp, region, 'price' AS driver, avg(price) / 1e5 AS value FROM f GROUP BY 1, 2 UNION ALL SELECT supp, region, 'disc', avg(discount) * 10 FROM f GROUP BY 1, 2),
        g AS (SELECT region, class AS cell, 'price' AS driver, ln(sum(area)) / 5 AS gamma FROM f GROUP BY 1, 2 UNION ALL SELECT region, class, 'disc', avg(discount) FROM f GROUP BY 1, 2),
        u AS (SELECT supp, region, cell, exp(sum(value * gamma)) AS e FROM x JOIN g USING (region, driver) GROUP BY 1, 2, 3), t AS (SELECT supp, sum(area) AS total FROM f GROUP BY 1)
        SELECT supp, region, cell, e / sum(e) OVER (PARTITION BY supp) AS weight, total * e / sum(e) OVER (PARTITION BY supp) AS heads FROM u JOIN t USING (supp)""",
)
def _(t: Tables):
    f = t.cells.join(t.geo, "supp")
    drivers = F.explode(F.array(F.struct(F.lit("price").alias("driver"), F.col("p").alias("v")), F.struct(F.lit("disc").alias("driver"), F.col("d").alias("v")))).alias("r")
    x = f.groupBy("supp", "region").agg((F.avg("price") / 1e5).alias("p"), (F.avg("discount") * 10).alias("d"))
    x = x.select("supp", "region", drivers).select("supp", "region", "r.driver", F.col("r.v").alias("value"))
    g = f.groupBy("region", F.col("class").alias("cell")).agg((F.log(F.sum("area")) / 5).alias("p"), F.avg("discount").alias("d"))
    g = g.select("region", "cell", drivers).select("region", "cell", "r.driver", F.col("r.v").alias("gamma"))
    return al.allocate_by_weights(x, g, f.groupBy("supp").agg(F.sum("area").alias("total")), "supp", "region", "driver", "cell", ["supp"])


def _coefficients(t: Tables):
    d = t.draws
    cov = F.when(F.col("cov") == "x0", "intercept").when(F.col("cov") == "x1", "log1p_lu_area_A").when(F.col("cov") == "x2", "log1p_GDP").otherwise("slope")
    raw = F.when(F.col("cov") == "x0", "intercept").when(F.col("cov") == "x1", "lu_area_A").when(F.col("cov") == "x2", "GDP").otherwise("unknown")
    beta = d.groupBy(F.lit("BOV").alias("species"), F.col("grp").alias("country"), cov.alias("driver")).agg(F.avg("value").alias("beta_total"))
    delta = d.groupBy(F.lit("BOV").alias("species"), F.col("class").alias("subtype"), raw.alias("driver")).agg(F.avg("value").alias("delta"))
    organic = d.groupBy(raw.alias("driver")).agg(F.max("value").alias("delta_org"))
    anchor = d.where(F.col("grp") != "g3").groupBy(F.lit("BOV").alias("species"), F.col("grp").alias("country")).agg(F.min("value").alias("anchor"))
    return beta, delta, organic, anchor


DRIVER = "CASE cov WHEN 'x0' THEN 'intercept' WHEN 'x1' THEN 'log1p_lu_area_A' WHEN 'x2' THEN 'log1p_GDP' ELSE {other} END"


@query(
    "r10_merge_coefficients", "draws", dbl="beta_total delta_dof delta_org gamma",
    sql=f"""WITH b AS (SELECT grp AS country, {DRIVER.format(other="'slope'")} AS driver, avg(value) AS beta_total FROM draws GROUP BY 1, 2),
        d AS (SELECT class AS subtype, {DRIVER.format(other="'unknown'")} AS driver, avg(value) AS delta FROM draws GROUP BY 1, 2), o AS (SELECT {DRIVER.format(other="'unknown'")} AS driver, max(value) AS o FROM draws GROUP BY 1),
        a AS (SELECT grp AS country, min(value) AS anchor FROM draws WHERE grp <> 'g3' GROUP BY 1),
        j AS (SELECT country, subtype, driver, beta_total, coalesce(delta, 0.0) AS delta_dof, coalesce(o, 0.0) + CASE WHEN driver = 'intercept' THEN coalesce(anchor, 0.0) / 2 ELSE 0 END AS s
            FROM b CROSS JOIN (SELECT DISTINCT class AS subtype FROM draws) LEFT JOIN d USING (subtype, driver) LEFT JOIN o USING (driver) LEFT JOIN a USING (country))
        SELECT 'BOV' AS species, country, subtype, m AS system, driver, beta_total, delta_dof, CASE m WHEN 'organic' THEN s ELSE -s END AS delta_org,
        beta_total + delta_dof + CASE m WHEN 'organic' THEN s ELSE -s END AS gamma FROM j CROSS JOIN (VALUES ('organic'), ('conventional')) k(m)""",
)
def _(t: Tables):
    return al.merge_coefficients(*_coefficients(t))


@query("r10_driver_overlap", "draws", sql="SELECT 'BOV' AS species, count(DISTINCT cov) AS n_drivers, count(DISTINCT CASE WHEN cov <> 'x3' THEN cov END) AS n_matched, false AS weak FROM draws")
def _(t: Tables):
    beta, delta, *_ = _coefficients(t)
    return al.driver_overlap(beta, delta)


@query(
    "r11_anchor_level", "cells geo", dbl="target:7 modelled:7",
    sql="""WITH f AS (SELECT * FROM cells JOIN geo USING (supp)), g AS (SELECT grp, least(greatest(avg(discount) * 6, 1e-4), 1 - 1e-4) AS target FROM f GROUP BY 1)
        SELECT grp, target, target AS modelled FROM g""",
)
def _(t: Tables):
    f = t.cells.join(t.geo, "supp")
    units = f.groupBy("grp", "supp", "year").agg((F.avg("price") / 3e4 - 1).alias("eta"), F.sum("area").alias("w"))
    targets = f.groupBy("grp").agg((F.avg("discount") * 6).alias("target"))
    solved = al.anchor_level(units, targets, ["grp"], "eta", "w", "target")
    level = units.join(solved, "grp").groupBy("grp", "target").agg(
        (F.sum(F.col("w") * logistic(F.col("eta") + F.col("anchor"))) / F.sum("w")).alias("modelled")
    )
    return level


@query(
    "r12_proportions", "panel", dbl="prop",
    sql="""WITH r AS (SELECT class FROM panel GROUP BY 1 ORDER BY sum(area) DESC, class LIMIT 1)
        SELECT grp, year, class, prop FROM (SELECT grp, year, class, area / sum(area) OVER (PARTITION BY grp, year) AS prop FROM panel) WHERE class <> (SELECT class FROM r)""",
)
def _(t: Tables):
    return al.proportions(t.panel, ["grp", "year"], "class", "area")


@query(
    "r13_pseudocounts", "lu",
    sql="""WITH t AS (SELECT cell, sum(area) AS s FROM lu GROUP BY 1), m AS (SELECT median(s) AS m FROM t), c AS (SELECT cell, class, area, round_even(area * 10.0 / m, 0)::DOUBLE AS "count" FROM lu, m)
        SELECT * FROM c WHERE cell IN (SELECT cell FROM c GROUP BY 1 HAVING sum("count") > 0)""",
)
def _(t: Tables):
    return al.to_pseudocounts(t.lu, ["cell"], "class", "area", level=10.0)


@query(
    "r14_stabilise", "fits", dbl="share",
    sql="""WITH z AS (SELECT class, avg(CASE WHEN obs = 0 THEN 1.0 ELSE 0 END) AS z FROM fits GROUP BY 1), s AS (SELECT "row", class, obs + 0.01 * (1 - z) AS s FROM fits JOIN z USING (class))
        SELECT "row", class, s / sum(s) OVER (PARTITION BY "row") AS share FROM s""",
)
def _(t: Tables):
    src = t.fits.select("row", "class", F.col("obs").alias("share"))
    return al.stabilise(src, ["row"], "class", "share", 0.01)


@query("r15_sample_shares")
def _(t: Tables):
    wide = t.panel.groupBy("grp", "year").agg(
        *[F.sum(F.when(F.col("class") == c, F.col("area")).otherwise(0.0)).alias(n) for c, n in (("ECONOMY", "D"), ("PROMO", "O"), ("SMALL", "F"))]
    )
    return al.sample_shares(wide, ["grp", "year"], ["D", "O", "F"], 20, 17)


# ---- null keys: nothing may get lost ------------------------------------------------------------------------------

NO_CLASS = "CASE WHEN class <> 'STANDARD' THEN class END"


def _unclassed(df):
    """The class STANDARD becomes null."""
    return df.withColumn("class", F.when(F.col("class") != "STANDARD", F.col("class")))


@query(
    "r1_null_class", "lu", dbl="area:7",
    sql=f"""WITH ln AS (SELECT cell, {NO_CLASS} AS class, sum(area) AS area FROM lu GROUP BY 1, 2), f AS (SELECT o_orderkey AS cell, CASE WHEN o_orderpriority = '1-URGENT' THEN 0.4 ELSE 0.0 END AS f FROM orders),
        b AS (SELECT cell, class, area, f, coalesce(class IN ('ECONOMY', 'PROMO'), false) AS p FROM ln JOIN f USING (cell) WHERE class IS DISTINCT FROM 'LARGE')
        SELECT cell, class, CASE WHEN p THEN area * (1 - f) ELSE area END AS area FROM b UNION ALL SELECT cell, 'LARGE', sum(area * f) FROM b WHERE p AND f > 0 GROUP BY 1""",
)
def _(t: Tables):
    flags = t.orders.select(F.col("o_orderkey").alias("cell"), F.when(F.col("o_orderpriority") == "1-URGENT", 0.4).otherwise(0.0).alias("f"))
    return al.carve_flag(_unclassed(t.lu), flags, "cell", "class", "area", "f", ["ECONOMY", "PROMO"], "LARGE")


@query(
    "r5_null_class", "lu", dbl="area:7",
    sql=f"""WITH {GEO_SQL}, p AS (SELECT lu.cell, geo, {NO_CLASS} AS class, area FROM lu LEFT JOIN cg USING (cell)),
        u AS (SELECT p.*, CASE WHEN geo IN (SELECT geo FROM s1) THEN geo WHEN substr(geo, 1, 2) IN (SELECT geo FROM s1) THEN substr(geo, 1, 2) END AS gu FROM p),
        o AS (SELECT cell, CASE class WHEN 'MEDIUM' THEN 'LARGE' ELSE class END AS class, area FROM u WHERE class IS DISTINCT FROM 'PROMO'
            UNION ALL SELECT cell, CASE target WHEN 'A' THEN 'ACTIVE' ELSE target END, area * share FROM u JOIN s1 ON s1.geo = gu WHERE class = 'PROMO'
            UNION ALL SELECT cell, CASE target WHEN 'A' THEN 'ACTIVE' ELSE target END, area * share FROM u CROSS JOIN mn WHERE class = 'PROMO' AND gu IS NULL)
        SELECT cell, class, sum(area) AS area FROM o GROUP BY 1, 2""",
)
def _(t: Tables):
    shares, cells = _shares(t)
    return al.apply_class_rules(_unclassed(t.lu), RULES, shares, cells, "cell", "class", "area")


NO_ZONE = "CASE WHEN supp % 7 <> 0 THEN supp END"


@query(
    "r6_null_class", "cells", dbl="area:7",
    sql=f"""WITH ob AS (SELECT cell AS pixel, {NO_ZONE} AS zone, {NO_CLASS} AS class, sum(area) AS area FROM cells GROUP BY 1, 2, 3),
        tg AS (SELECT {NO_ZONE} AS zone, {NO_CLASS} AS class, sum(price * discount) AS area FROM cells GROUP BY 1, 2),
        zk AS (SELECT zone, class, sum(obs) AS obs, sum(tgt) AS tgt FROM (SELECT zone, class, area AS obs, 0.0 AS tgt FROM ob UNION ALL SELECT zone, class, 0.0, area FROM tg) WHERE class IN ('ECONOMY', 'MEDIUM', 'PROMO', 'SMALL') GROUP BY 1, 2),
        z1 AS (SELECT *, sum(obs) OVER (PARTITION BY zone) AS a, sum(tgt) OVER (PARTITION BY zone) AS b FROM zk),
        z3 AS (SELECT *, greatest(obs - tgt * a / b, 0) AS s, greatest(tgt * a / b - obs, 0) AS d FROM z1 WHERE a > 0), z4 AS (SELECT *, sum(d) OVER (PARTITION BY zone) AS dd FROM z3),
        fl AS (SELECT zone, class AS f, class AS k, obs - s AS v FROM z4 UNION ALL SELECT x.zone, x.class, y.class, x.s * y.d / y.dd FROM z4 x JOIN z4 y ON x.zone IS NOT DISTINCT FROM y.zone WHERE x.s > 0 AND y.d > 0),
        fs AS (SELECT zone, f, k, v / sum(v) OVER (PARTITION BY zone, f) AS sh FROM fl WHERE v > 0)
        SELECT pixel, ob.zone, k AS class, sum(area * sh) AS area FROM ob JOIN fs ON ob.zone IS NOT DISTINCT FROM fs.zone AND ob.class = f GROUP BY 1, 2, 3
        UNION ALL SELECT pixel, zone, class, area FROM ob WHERE class IS NULL OR class = 'LARGE'""",
)
def _(t: Tables):
    src = _unclassed(t.cells).withColumn("zone", F.when(F.col("supp") % 7 != 0, F.col("supp")))
    obs = src.groupBy(F.col("cell").alias("pixel"), "zone", "class").agg(F.sum("area").alias("area"))
    targets = src.groupBy("zone", "class").agg(F.sum(F.col("price") * F.col("discount")).alias("area"))
    return al.rake_to_targets(obs, targets, ["ECONOMY", "MEDIUM", "PROMO", "SMALL"], "pixel", "zone", "class", "area")


NO_COUNTRY = "CASE WHEN region <> 'ASIA' THEN region END"


def _stateless(t: Tables):
    return t.cells.join(t.geo, "supp").withColumn("region", F.when(F.col("region") != "ASIA", F.col("region")))


@query(
    "r7_null_country", "cells geo", dbl="heads:6",
    sql=f"""WITH f AS (SELECT * REPLACE ({NO_COUNTRY} AS region) FROM cells JOIN geo USING (supp)), tot AS (SELECT region, year, sum(area) AS total FROM f GROUP BY 1, 2),
        pr AS (SELECT region, year, sum(CASE WHEN class IN ('ECONOMY', 'LARGE') THEN area ELSE 0 END) / sum(area) AS d, sum(CASE WHEN class IN ('MEDIUM', 'PROMO') THEN area ELSE 0 END) / sum(area) AS o FROM f GROUP BY 1, 2),
        j AS (SELECT tot.*, d, o, 1 - d - o AS w FROM tot JOIN pr ON tot.region IS NOT DISTINCT FROM pr.region AND tot.year = pr.year)
        SELECT region, sum(total * CASE s WHEN 'D' THEN d WHEN 'O' THEN o ELSE w END) AS heads, s AS subtype FROM j CROSS JOIN (VALUES ('D'), ('O'), ('F')) a(s) GROUP BY region, s""",
)
def _(t: Tables):
    f = _stateless(t)
    part = lambda *names: (F.sum(F.when(F.col("class").isin(*names), F.col("area")).otherwise(0.0)) / F.sum("area"))
    totals = f.groupBy("region", "year").agg(F.sum("area").alias("total")).withColumn("unit", F.col("region"))
    production = f.groupBy("region", "year").agg(part("ECONOMY", "LARGE").alias("D"), part("MEDIUM", "PROMO").alias("O"), part("SMALL", "STANDARD").alias("F"))
    nothing = production.limit(0)
    dairy = nothing.select(F.col("region").alias("unit"), "year", F.col("D").alias("dairy_share"))
    organic = nothing.select("region", "year", F.col("D").alias("organic_share"))
    out = al.allocate_subtypes(totals, production, dairy, organic, "region", "unit", ["year"])
    return out.groupBy("region", "subtype").agg(F.sum("heads").alias("heads"))


@query(
    "r9_null_country", "cells geo", dbl="heads:5",
    sql=f"""WITH f AS (SELECT * REPLACE ({NO_COUNTRY} AS region) FROM cells JOIN geo USING (supp)), x AS (SELECT supp, region, avg(price) / 1e5 AS v FROM f GROUP BY 1, 2),
        g AS (SELECT region, class AS cell, ln(sum(area)) / 5 AS gamma FROM f GROUP BY 1, 2), t AS (SELECT supp, sum(area) AS total FROM f GROUP BY 1),
        u AS (SELECT supp, x.region, cell, exp(v * gamma) AS e FROM x JOIN g ON x.region IS NOT DISTINCT FROM g.region)
        SELECT supp, region, cell, total * e / sum(e) OVER (PARTITION BY supp) AS heads FROM u JOIN t USING (supp)""",
)
def _(t: Tables):
    f = _stateless(t)
    x = f.groupBy("supp", "region").agg((F.avg("price") / 1e5).alias("value")).withColumn("driver", F.lit("price"))
    g = f.groupBy("region", F.col("class").alias("cell")).agg((F.log(F.sum("area")) / 5).alias("gamma")).withColumn("driver", F.lit("price"))
    totals = f.groupBy("supp").agg(F.sum("area").alias("total"))
    return al.allocate_by_weights(x, g, totals, "supp", "region", "driver", "cell", ["supp"]).drop("weight")
