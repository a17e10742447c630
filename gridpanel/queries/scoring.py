"""Batch prediction over rows and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpanel.operators import drawstore as ds
from gridpanel.operators import nested as ne
from gridpanel.operators import score as so
from gridpanel.plans.skew import group_quantiles
from gridpanel.queries.base import Tables, query
from gridpanel.queries.design import ALT, COVS, alt_block
from gridpanel.queries.spatial import CLASSES as LU_CLASSES
from gridpanel.queries.spatial import SHARES
from gridpanel.session import written

CLASSES = ["c0", "c1", "c2", "c3"]
SCALE = 5.0

BETA = """bg AS (SELECT grp, cov, class, avg(value) * 5 AS beta FROM draws GROUP BY 1, 2, 3), bp AS (SELECT cov, class, avg(value) * 5 AS beta FROM draws GROUP BY 1, 2),
    dl AS (SELECT "row", grp, 'x0' AS cov, x0 AS value FROM design UNION ALL SELECT "row", grp, 'x1', x1 FROM design UNION ALL SELECT "row", grp, 'x2', x2 FROM design UNION ALL SELECT "row", grp, 'x3', x3 FROM design),
    ut AS (SELECT "row", d.grp, p.class, sum(value * coalesce(g.beta, p.beta)) AS u FROM dl d JOIN bp p USING (cov) LEFT JOIN bg g ON g.grp = d.grp AND g.cov = d.cov AND g.class = p.class GROUP BY 1, 2, 3),
    pr AS (SELECT "row", grp, class, u, exp(u) / sum(exp(u)) OVER (PARTITION BY "row") AS p FROM ut)"""


def coefs(t: Tables):
    """Group coefficients (mean draws × 5) and the pooled row."""
    d = t.draws.withColumn("value", F.col("value") * SCALE)
    by_group = so.coefficient_matrix(d, ["grp"], "cov", "class", "value", COVS, CLASSES)
    pooled = so.coefficient_matrix(d.withColumn("grp", F.lit(so.POOLED)), ["grp"], "cov", "class", "value", COVS, CLASSES)
    return by_group.unionByName(pooled)


def rows(t: Tables):
    return so.feature_array(t.design, COVS)


@query("q1_utilities", "draws design", dbl="u", sql=f'WITH {BETA} SELECT "row", class, u FROM ut')
def _(t: Tables):
    scored = so.predict_shares(rows(t), coefs(t), "grp")
    return so.explode_classes(scored, ["row"], "u", CLASSES, "u")


@query("q2_softmax_long", "fits", dbl="p", sql='SELECT "row", class, exp(obs * 3) / sum(exp(obs * 3)) OVER (PARTITION BY "row") AS p FROM fits')
def _(t: Tables):
    return so.softmax_long(t.fits.select("row", "class", (F.col("obs") * 3).alias("u")), ["row"], "u").drop("u")


@query("q3_predict_mean", "draws design", dbl="p", sql=f'WITH {BETA} SELECT "row", grp = \'g4\' AS pooled, class, p FROM pr')
def _(t: Tables):
    return so.explode_classes(so.predict_shares(rows(t), coefs(t), "grp"), ["row", "pooled"], "p", CLASSES)


def all_draws(t: Tables):
    """Every draw of every chain, under one number."""
    d = t.draws.withColumn("value", F.col("value") * SCALE)
    return d.withColumn("draw", F.col("chain").cast("long") * F.lit(2**32) + F.col("iter"))


def model(t: Tables):
    """All draws as records: a matrix per draw for every group, and the pooled one."""
    d = all_draws(t)
    args = ("grp", "draw", "cov", "class", "value", COVS, CLASSES)
    return ds.coefficient_parts(d, *args).unionByName(ds.coefficient_parts(d.withColumn("grp", F.lit(so.POOLED)), *args))


IJ = [(i, j) for i in range(4) for j in range(4)]
# one row per row and draw, the coefficients of its group (or the pooled ones) as columns b<class><covariate>
WIDE = f"""wo AS (SELECT grp, chain, iter, {", ".join(f"avg(value) FILTER (class = 'c{i}' AND cov = 'x{j}') * 5 AS b{i}{j}" for i, j in IJ)} FROM draws GROUP BY 1, 2, 3),
    wp AS (SELECT 'g4' AS grp, chain, iter, {", ".join(f"avg(b{i}{j}) AS b{i}{j}" for i, j in IJ)} FROM wo GROUP BY 2, 3), wd AS (SELECT * FROM wo UNION ALL SELECT * FROM wp),
    wu AS (SELECT "row", grp, chain, iter, x0, x1, x2, x3, {", ".join("+".join(f"b{i}{j} * x{j}" for j in range(4)) + f" AS u{i}" for i in range(4))} FROM design JOIN wd USING (grp))"""


def soft(u: str = "u") -> str:
    """Columns p0..p3: the softmax of u0..u3."""
    high = f"greatest({', '.join(f'{u}{i}' for i in range(4))})"
    return ", ".join(f"exp({u}{i} - {high}) / ({' + '.join(f'exp({u}{k} - {high})' for k in range(4))}) AS p{i}" for i in range(4))


def unpivoted(value: str, out: str, n: int = 4) -> str:
    return f"unnest([{', '.join(repr(f'c{i}') for i in range(n))}]) AS class, unnest([{', '.join(value.format(i=i) for i in range(n))}]) AS {out}"


@query(
    "q4_posterior_predictive", "draws design", dbl="p",
    sql=f"""WITH {WIDE}, pd AS (SELECT *, {soft()} FROM wu)
        SELECT "row", n_draws, {unpivoted("a{i}", "p")} FROM (SELECT "row", count(*) AS n_draws, {", ".join(f"avg(p{i}) AS a{i}" for i in range(4))} FROM pd GROUP BY 1)""",
)
def _(t: Tables):
    p = ds.predictive_shares(rows(t), model(t), ["row"], "grp", 4)
    return so.explode_classes(p, ["row", "n_draws"], "p", CLASSES)


ICDF = """CASE WHEN v < 0.02425 THEN (((((-7.784894002430293e-03 * ql + -3.223964580411365e-01) * ql + -2.400758277161838e+00) * ql + -2.549732539343734e+00) * ql + 4.374664141464968e+00) * ql + 2.938163982698783e+00)
    / ((((7.784695709041462e-03 * ql + 3.224671290700398e-01) * ql + 2.445134137142996e+00) * ql + 3.754408661907416e+00) * ql + 1)
    WHEN v > 0.97575 THEN -(((((-7.784894002430293e-03 * qh + -3.223964580411365e-01) * qh + -2.400758277161838e+00) * qh + -2.549732539343734e+00) * qh + 4.374664141464968e+00) * qh + 2.938163982698783e+00)
    / ((((7.784695709041462e-03 * qh + 3.224671290700398e-01) * qh + 2.445134137142996e+00) * qh + 3.754408661907416e+00) * qh + 1)
    ELSE (((((-3.969683028665376e+01 * r + 2.209460984245205e+02) * r + -2.759285104469687e+02) * r + 1.383577518672690e+02) * r + -3.066479806614716e+01) * r + 2.506628277459239e+00) * (v - 0.5)
    / (((((-5.447609879822406e+01 * r + 1.615858368580409e+02) * r + -1.556989798598866e+02) * r + 6.680131188771972e+01) * r + -1.328068155288572e+01) * r + 1) END"""


def icdf_sql(source: str) -> str:
    """Rows of ``source`` (with a probability column v) plus ``z``, its standard normal quantile."""
    return (
        f"SELECT *, {ICDF} AS z FROM (SELECT *, power(v - 0.5, 2) AS r, sqrt(-2 * ln(v)) AS ql, sqrt(-2 * ln(1 - v)) AS qh FROM ({source}))"
    )


@query(
    "q5_unseen_marginal", "draws design", dbl="p",
    sql=f"""WITH {BETA}, sd AS (SELECT cov, class, stddev_samp(beta) AS sd FROM bg GROUP BY 1, 2), mc AS (SELECT CAST(unnest(range(1, 26)) AS INTEGER) AS draw),
        hu AS (SELECT draw, cov, class, (CAST('0x' || substr(md5(concat_ws('|', '19', CAST(draw AS VARCHAR), cov, class)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0 AS v FROM mc CROSS JOIN (SELECT cov, class FROM bp)),
        nz AS ({icdf_sql('SELECT * FROM hu')}), al AS (SELECT grp, 1 AS draw, cov, class, beta FROM bg UNION ALL SELECT 'g4', draw, cov, class, beta + sd * z FROM bp JOIN sd USING (cov, class) JOIN nz USING (cov, class)),
        ud AS (SELECT "row", draw, class, sum(value * beta) AS u FROM dl JOIN al USING (grp, cov) GROUP BY 1, 2, 3), s2 AS (SELECT *, exp(u) / sum(exp(u)) OVER (PARTITION BY "row", draw) AS p FROM ud)
        SELECT "row", class, avg(p) AS p, count(*) AS n_draws FROM s2 GROUP BY 1, 2""",
)
def _(t: Tables):
    d = t.draws.withColumn("value", F.col("value") * SCALE)
    by_group = d.groupBy("grp", "cov", "class").agg(F.avg("value").alias("value"))
    pooled = d.groupBy("cov", "class").agg(F.avg("value").alias("value"))
    marg = so.marginal_draws(by_group, pooled, "cov", "class", "value", 25, 19).withColumn("grp", F.lit(so.POOLED))
    unseen = so.coefficient_matrix(marg, ["grp", "draw"], "cov", "class", "value", COVS, CLASSES)
    fitted = so.coefficient_matrix(by_group.withColumn("draw", F.lit(1)), ["grp", "draw"], "cov", "class", "value", COVS, CLASSES)
    p = so.predict_predictive(rows(t), fitted.unionByName(unseen), ["row"], "grp", "draw", 4)
    return so.explode_classes(p, ["row", "n_draws"], "p", CLASSES)


@query(
    "q6_expand_classes", "draws design", dbl="p",
    sql=f"""WITH {BETA}, ex AS (SELECT "row", k.o AS class, u - ln(k.n) AS u FROM ut JOIN (VALUES ('c0', 'c0a', 2), ('c0', 'c0b', 2), ('c1', 'c1a', 1), ('c2', 'c2a', 1), ('c3', 'c3a', 1)) k(class, o, n) USING (class))
        SELECT "row", class, exp(u) / sum(exp(u)) OVER (PARTITION BY "row") AS p FROM ex""",
)
def _(t: Tables):
    scored = so.predict_shares(rows(t), coefs(t), "grp", class_map=[0, 0, 1, 2, 3])
    return so.explode_classes(scored, ["row"], "p", ["c0a", "c0b", "c1a", "c2a", "c3a"])


@query(
    "q7_predict_count", "draws design", dbl="mu density",
    sql=f"""WITH {BETA} SELECT u."row", least(exp(u + ln(x1 + 1)) / (x1 + 1), 2.5) * (x1 + 1) AS mu, 1.7 * exp(u) AS density FROM ut u JOIN design d ON d."row" = u."row" WHERE class = 'c1'""",
)
def _(t: Tables):
    scored = so.predict_shares(rows(t), coefs(t), "grp")
    eta, off = F.col("u")[1], F.log(F.col("x1") + 1)
    capped = so.predict_count(eta, off, cap=F.lit(2.5))
    return scored.select("row", capped.alias("mu"), so.predict_count(eta, off, dispersion=F.lit(1.7), density=True).alias("density"))


def stored_quantiles(t: Tables):
    """Density quantiles of the training rows per class, as a fit stores them."""
    k = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.lit(i + 1.0).alias("f")) for i, c in enumerate(CLASSES)])).alias("k")
    long = t.design.select(k, "x1").select("k.class", (F.col("x1") * F.col("k.f")).alias("density"))
    return group_quantiles(long, ["class"], "density", {"99%": 0.99, "100%": 1.0}).unpivot(["class"], ["99%", "100%"], "quantile", "density")


@query(
    "q7_predict_count_draws", "draws design", dbl="mu:7",
    sql=f"""WITH {WIDE}, rd AS (SELECT chain, iter, {", ".join(f"1 + abs(avg(value) FILTER (class = 'c{i}')) AS r{i}" for i in range(4))} FROM draws GROUP BY 1, 2),
        qs AS (SELECT quantile_cont(x1, 0.99) AS q FROM design)
        SELECT "row", n_draws, {unpivoted("a{i}", "mu")} FROM (SELECT "row", count(*) AS n_draws, {", ".join(f"avg(least(r{i} * exp(u{i}), q * {i + 1}) * (x1 + 1)) AS a{i}" for i in range(4))}
            FROM wu JOIN rd USING (chain, iter) CROSS JOIN qs GROUP BY 1)""",
)
def _(t: Tables):
    src = ds.stored_cap(rows(t).withColumn("off", F.log(F.col("x1") + 1)), stored_quantiles(t), "99%", CLASSES)
    r = all_draws(t).groupBy("draw").agg(F.array(*[1 + F.abs(F.avg(F.when(F.col("class") == c, F.col("value") / SCALE))) for c in CLASSES]).alias("r"))
    out = ds.predictive_counts(src, model(t).unionByName(ds.vector_parts(r, "draw", "r", "dispersion")), ["row"], "grp", "off", 4, cap="cap")
    return so.explode_classes(out, ["row", "n_draws"], "mu", CLASSES, "mu")


NEST = {"c0": ["n1"], "c1": ["n1"], "c2": [], "c3": []}


ROOT = ["x0", "x12", "x3"]  # the root's design: x1 and x2 are routed into one column
TREE = ne.nest_tree(NEST, COVS, routes={"root": [["x0"], ["x1", "x2"], ["x3"]]}, alternatives=["root"])


def nested_model(t: Tables):
    """Records of a nest {c0, c1} beside c2 and c3: inclusive values enter n1 with 0.6 + b33 / 10 and c2 with 0.1; δ of the root per draw."""
    d = all_draws(t)
    d = d.unionByName(d.withColumn("grp", F.lit(so.POOLED)).groupBy("param", "cov", "class", "grp", "chain", "iter", "draw").agg(F.avg("value").alias("value")))
    inner = d.where(F.col("class").isin("c0", "c1")).select("grp", "draw", "cov", "class", "value")
    own = d.where(F.col("class").isin("c2", "c3") & (F.col("cov") != "x2")).select(
        "grp", "draw", F.when(F.col("cov") == "x1", "x12").otherwise(F.col("cov")).alias("cov"), "class", "value")
    pivot = d.where((F.col("class") == "c3") & (F.col("cov") == "x3")).groupBy("grp", "draw").agg(F.avg("value").alias("value"))
    pairs = F.explode(F.array(F.struct(F.lit("n1").alias("class"), (0.6 + F.col("value") / 10).alias("v")), F.struct(F.lit("c2").alias("class"), F.lit(0.1).alias("v")))).alias("e")
    through = pivot.select("grp", "draw", F.lit("IV_n1").alias("cov"), pairs).select("grp", "draw", "cov", "e.class", F.col("e.v").alias("value"))
    mean = lambda c: F.avg(F.when(F.col("class") == c, F.col("value")))
    delta = d.where(F.col("grp") != so.POOLED).groupBy("draw").agg(F.array(mean("c0"), mean("c1"), F.lit(0.0)).alias("v"))
    parts = ne.node_parts(inner, TREE, "n1", "grp", "draw", "cov", "class", "value", COVS)
    parts = parts.unionByName(ne.node_parts(own.unionByName(through), TREE, "root", "grp", "draw", "cov", "class", "value", ROOT))
    return parts.unionByName(ne.delta_parts(delta, "root", "draw", "v"))


def nested_rows(t: Tables):
    return rows(t).withColumn("z", F.array("x3", F.col("x1") / 4, F.lit(0.0)))


def nested_sql(source: str) -> str:
    """Columns of log probabilities l0..l3 over ``source`` with b<class><covariate>, d0, d1, the design x0..x3 and the alternative values z0, z1."""
    u = [" + ".join(f"b{i}{j} * x{j}" for j in range(4)) for i in (0, 1)]
    r = [f"b{i}0 * x0 + b{i}1 * (x1 + x2) + b{i}3 * x3" for i in (2, 3)]
    return f"""SELECT *, vn - lt + u0 - iv AS l0, vn - lt + u1 - iv AS l1, v2 - lt AS l2, v3 - lt AS l3 FROM (SELECT *, ln(exp(vn) + exp(v2) + exp(v3)) AS lt FROM (
        SELECT *, (0.6 + b33 / 10) * iv + d0 * z0 AS vn, r2 + 0.1 * iv + d1 * z1 AS v2, r3 AS v3 FROM (SELECT *, ln(exp(u0) + exp(u1)) AS iv FROM (
        SELECT *, {u[0]} AS u0, {u[1]} AS u1, {r[0]} AS r2, {r[1]} AS r3 FROM ({source})))))"""


DELTAS = "dd AS (SELECT chain, iter, avg(value) FILTER (class = 'c0') * 5 AS d0, avg(value) FILTER (class = 'c1') * 5 AS d1 FROM draws GROUP BY 1, 2)"
NESTED = 'SELECT wd.*, d0, d1, "row", x0, x1, x2, x3, x3 AS z0, x1 / 4 AS z1 FROM design JOIN wd USING (grp) JOIN dd USING (chain, iter)'


@query(
    "q8_predict_nested", "draws design", dbl="p",
    sql=f"""WITH {WIDE}, {DELTAS}, pl AS ({nested_sql(NESTED)})
        SELECT "row", n_draws, {unpivoted("a{i}", "p")} FROM (SELECT "row", count(*) AS n_draws, {", ".join(f"avg(exp(l{i})) AS a{i}" for i in range(4))} FROM pl GROUP BY 1)""",
)
def _(t: Tables):
    out = ne.predict_nested(nested_rows(t), nested_model(t), ["row"], "grp", TREE, z="z")
    return so.explode_classes(out, ["row", "n_draws"], "p", TREE.classes)


STEP = "1e-4::DOUBLE"
MOVED = f"""SELECT * EXCLUDE (x0, x1, x2, x3), {", ".join(f"x{j} + CASE WHEN j = {j} THEN sg * {STEP} ELSE 0 END AS x{j}" for j in range(4))}
    FROM ({NESTED}) CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS j) CROSS JOIN (SELECT unnest([-1, 1]) AS sg)"""


@query(
    "q13_nested_effects", "draws design", dbl="median:5 q025:5 q975:5",
    sql=f"""WITH {WIDE}, {DELTAS}, pl AS ({nested_sql(MOVED)}),
        pd AS (SELECT chain, iter, 'x' || j AS cov, {", ".join(f"sum(sg * l{i}) / (count(*) * {STEP}) AS a{i}" for i in range(4))} FROM pl GROUP BY 1, 2, 3),
        ce AS (SELECT cov, {unpivoted("a{i} - (a0 + a1 + a2 + a3) / 4", "ame")} FROM pd)
        SELECT cov, class, median(ame) AS median, quantile_cont(ame, 0.025) AS q025, quantile_cont(ame, 0.975) AS q975 FROM ce GROUP BY 1, 2""",
)
def _(t: Tables):
    return ne.nested_effects(nested_rows(t), nested_model(t), ["row"], "grp", TREE, COVS, z="z")


@query(
    "q9_alt_utility", "fits draws", dbl="u_alt",
    sql=f"""WITH {ALT} SELECT "row", alternative, CASE alternative WHEN 'right' THEN 0.0 ELSE z * (SELECT avg(value) * 100 FROM draws WHERE class = 'c0') END AS u_alt FROM zz""",
)
def _(t: Tables):
    delta = t.draws.where(F.col("class").isin("c0", "c1")).groupBy("class").agg((F.avg("value") * 100).alias("delta"))
    delta = delta.select(F.lit("block").alias("block"), F.when(F.col("class") == "c0", "left").otherwise("right").alias("alternative"), "delta")
    return so.alt_utility(alt_block(t).withColumn("block", F.lit("block")), delta, ["row"], baseline="right")


def grown(i: int) -> str:
    return f"greatest(least(CASE WHEN x1 <= t{i}0 + 2.5 THEN t{i}1 WHEN x3 <= t{i}3 + 0.5 THEN t{i}2 ELSE t{i}3 END, 1.0), -1.0) AS f{i}"


HYBRID = f"""{WIDE}, wt AS (SELECT chain, iter, {", ".join(f"b{i}{j} AS t{i}{j}" for i, j in IJ)} FROM wp),
    wf AS (SELECT wu.*, {", ".join(grown(i) for i in range(4))} FROM wu JOIN wt USING (chain, iter)), wh AS (SELECT *, {", ".join(f"u{i} + f{i} - (f0 + f1 + f2 + f3) / 4 AS h{i}" for i in range(4))} FROM wf)"""


def draw_trees(t: Tables):
    """One tree per draw and class, grown from that draw's pooled coefficients."""
    v = all_draws(t).groupBy("draw", F.col("class").alias("ensemble")).pivot("cov", COVS).agg(F.avg("value"))
    spec = [(1, 1, F.col("x0") + 2.5), (2, -1, F.col("x1")), (3, 3, F.col("x3") + 0.5), (4, -1, F.col("x2")), (5, -1, F.col("x3"))]
    cells = F.array(*[F.struct(F.lit(n).alias("node"), F.lit(k).alias("var"), e.alias("value")) for n, k, e in spec])
    return v.select("draw", "ensemble", F.lit(1).alias("tree"), F.explode(cells).alias("n")).select("draw", "ensemble", "tree", "n.*")


TREE_TERM = {"x": "x", "ensembles": CLASSES, "cap": 1.0}


@query(
    "q11_score_trees", "draws design", dbl="f",
    sql=f"""WITH {WIDE}, wt AS (SELECT chain, iter, {", ".join(f"b{i}{j} AS t{i}{j}" for i, j in IJ)} FROM wp)
        SELECT "row", {unpivoted("a{i}", "f")} FROM (SELECT "row", {", ".join(f"avg(f{i}) AS a{i}" for i in range(4))} FROM (SELECT "row", {", ".join(grown(i) for i in range(4))} FROM design CROSS JOIN wt) GROUP BY 1)""",
)
def _(t: Tables):
    out = ds.ensemble_means(rows(t), ds.tree_parts(draw_trees(t)), ["row"], "x", CLASSES, 1.0)
    return so.explode_classes(out, ["row"], "f", CLASSES, "f")


@query(
    "q15_hybrid_prediction", "draws design", dbl="p",
    sql=f"""WITH {HYBRID}, pd AS (SELECT "row", {soft("h")} FROM wh)
        SELECT "row", n_draws, {unpivoted("a{i}", "p")} FROM (SELECT "row", count(*) AS n_draws, {", ".join(f"avg(p{i}) AS a{i}" for i in range(4))} FROM pd GROUP BY 1)""",
)
def _(t: Tables):
    parts = model(t).unionByName(ds.tree_parts(draw_trees(t)))
    out = ds.predictive_shares(rows(t), parts, ["row"], "grp", 4, trees=TREE_TERM)
    return so.explode_classes(out, ["row", "n_draws"], "p", CLASSES)


def state(t: Tables):
    cols = [(F.sum(F.when(F.col("class") == c, F.col("area")).otherwise(0.0)) / F.sum("area")).alias(c) for c in LU_CLASSES]
    return t.lattice.groupBy("slice", "ix", "iy").agg(*cols).withColumn("grp", F.lit("all"))


def state_coefs(t: Tables):
    """Intercept = log of the class share; a focal slope of 1.5 on the own class."""
    tot = t.lattice.groupBy("class").agg(F.sum("area").alias("a"))
    wide = tot.agg(F.sum("a").alias("_t"), *[F.sum(F.when(F.col("class") == c, F.col("a"))).alias(c) for c in LU_CLASSES])
    b = F.array(*[
        F.array(F.log(F.col(c) / F.col("_t")), *[F.lit(1.5 if i == j else 0.0) for j in range(len(LU_CLASSES))]) for i, c in enumerate(LU_CLASSES)
    ])
    return wide.select(F.lit(so.POOLED).alias("grp"), b.alias("b"))


def one_step(t: Tables):
    cf = written(state_coefs(t))  # one row; every step reads it twice
    return lambda s: so.project_step(s, ["slice", "ix", "iy", "grp"], ["slice"], "ix", "iy", LU_CLASSES, [], cf, "grp")


@query(
    "q12_project_step", "lattice", dbl=" ".join(LU_CLASSES) + " delta",
    sql=f"""WITH {SHARES}, k AS (SELECT class, ln(sum(area) / sum(sum(area)) OVER ()) AS b FROM lattice GROUP BY 1),
        g AS (SELECT slice, ix, iy, class, b, coalesce(share, 0.0) AS y, CASE WHEN n_neighbours = 8 THEN coalesce(s, 0.0) / 8 ELSE 0.0 END AS fo FROM pos CROSS JOIN k LEFT JOIN sh USING (slice, ix, iy, class) LEFT JOIN foc USING (slice, ix, iy, class) LEFT JOIN cnt USING (slice, ix, iy)),
        n AS (SELECT *, 0.5 * y + 0.5 * exp(b + 1.5 * fo) / sum(exp(b + 1.5 * fo)) OVER (PARTITION BY slice, ix, iy) AS v FROM g)
        SELECT slice, ix, iy, 'all' AS grp, {', '.join(f"max(CASE WHEN class = '{c}' THEN v END) AS {c}" for c in LU_CLASSES)}, max(abs(v - y)) AS delta FROM n GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    t.lattice = written(t.lattice)  # the coefficients and the state read it
    return one_step(t)(written(state(t)))


@query("q12_projection_trajectory")
def _(t: Tables):
    t.lattice = written(t.lattice)  # the coefficients and the state read it
    _, rows_ = so.project(written(state(t)), 3, 1e-4, one_step(t), LU_CLASSES)
    return rows_


@query(
    "q13_marginal_effects", "draws design", dbl="ame",
    sql=f"""WITH {BETA}, be AS (SELECT * FROM bg UNION ALL SELECT 'g4', * FROM bp), mp AS (SELECT grp, class, avg(p) AS mp, count(*) AS n FROM pr GROUP BY 1, 2),
        a AS (SELECT grp, cov, class, n, beta - sum(beta * mp) OVER (PARTITION BY grp, cov) AS a FROM be JOIN mp USING (grp, class)), m AS (SELECT cov, class, sum(a * n) / sum(n) AS ame FROM a GROUP BY 1, 2)
        SELECT cov, class, ame - avg(ame) OVER (PARTITION BY cov) AS ame FROM m""",
)
def _(t: Tables):
    p = so.explode_classes(so.predict_shares(rows(t), coefs(t), "grp"), ["grp"], "p", CLASSES)
    d = t.draws
    own = d.groupBy("grp", "cov", "class").agg((F.avg("value") * SCALE).alias("beta"))
    unseen = d.groupBy(F.lit("g4").alias("grp"), "cov", "class").agg((F.avg("value") * SCALE).alias("beta"))
    return so.marginal_effects(p, own.unionByName(unseen), "grp", "class", "cov")


@query(
    "q14_partial_dependence", "draws design", dbl="value p",
    sql=f"""WITH {WIDE}, wt AS (SELECT chain, iter, {", ".join(f"b{i}{j} AS t{i}{j}" for i, j in IJ)} FROM wp), m AS (SELECT avg(x0) AS x0, avg(x2) AS x2, avg(x3) AS x3, min(x1) AS lo, max(x1) AS hi FROM design),
        g AS (SELECT CAST(i AS INTEGER) AS point, lo + (hi - lo) * i / 19.0::DOUBLE AS x1, x0, x2, x3 FROM m CROSS JOIN (SELECT unnest(range(20)) AS i)),
        gu AS (SELECT wd.grp, point, x1, {", ".join("+".join(f"b{i}{j} * x{j}" for j in range(4)) + f" AS u{i}" for i in range(4))}, {", ".join(grown(i) for i in range(4))} FROM g CROSS JOIN wd JOIN wt USING (chain, iter)),
        gh AS (SELECT *, {", ".join(f"u{i} + f{i} - (f0 + f1 + f2 + f3) / 4 AS h{i}" for i in range(4))} FROM gu), pd AS (SELECT *, {soft("h")} FROM gh)
        SELECT CASE grp WHEN 'g4' THEN 'pooled' ELSE grp END AS grp, point, x1 AS value, n_draws, {unpivoted("a{i}", "p")}
        FROM (SELECT grp, point, x1, count(*) AS n_draws, {", ".join(f"avg(p{i}) AS a{i}" for i in range(4))} FROM pd GROUP BY 1, 2, 3)""",
)
def _(t: Tables):
    parts = model(t).unionByName(ds.tree_parts(draw_trees(t)))
    out = ds.partial_dependence(t.design, parts, COVS, "x1", "grp", 4, 20, trees=TREE_TERM)
    out = out.withColumn("grp", F.when(F.col("grp") == so.POOLED, "pooled").otherwise(F.col("grp")))
    return so.explode_classes(out, ["grp", "point", "value", "n_draws"], "p", CLASSES)
