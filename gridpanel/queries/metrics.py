"""Fit metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpanel.operators import drawstore as ds
from gridpanel.operators import metrics as me
from gridpanel.queries.base import Tables, query
from gridpanel.queries.scoring import WIDE, model, rows
from gridpanel.queries.spatial import _h

CLL = """pc AS (SELECT {by}class, count(*) AS n, sum(obs) AS so, avg(obs) AS mo, avg({p}) AS mp, sum(obs * ln(greatest({p}, 1e-12))) AS ll, sum(CASE WHEN obs > 0 THEN obs * ln(obs) ELSE 0 END) AS lp, corr(obs, {p}) AS c FROM {src} GROUP BY ALL),
    cl AS (SELECT *, so * ln(greatest(mo, 1e-12)) AS l0 FROM pc)"""
FIT = "sum(ll) AS ll, sum(l0) AS ll_null, sum(lp) AS ll_perfect, 1 - sum(ll) / sum(l0) AS mcfadden, (sum(ll) - sum(l0)) / (sum(lp) - sum(l0)) AS normalised"
FIT_DBL = "ll:5 ll_null:5 ll_perfect:5 mcfadden normalised"


def cll(by: str = "", p: str = "pred", src: str = "fits") -> str:
    return CLL.format(by=f"{by}, " if by else "", p=p, src=src)


@query("e1_share_fit", "fits", dbl=FIT_DBL, sql=f"WITH {cll()} SELECT max(n) AS n, {FIT} FROM cl")
def _(t: Tables):
    return me.share_fit(t.fits, "class", "obs", "pred")


@query("e1_share_fit_by_group", "fits", dbl=FIT_DBL, sql=f"WITH {cll('grp')} SELECT grp, max(n) AS n, {FIT} FROM cl GROUP BY 1")
def _(t: Tables):
    return me.share_fit(t.fits, "class", "obs", "pred", ["grp"])


@query(
    "e1_share_beating_null", "fits", dbl="share_beating_null",
    sql=f"WITH {cll('grp')} SELECT avg(CASE WHEN a > b THEN 1.0 ELSE 0 END) AS share_beating_null FROM (SELECT grp, sum(ll) AS a, sum(l0) AS b FROM cl GROUP BY 1)",
)
def _(t: Tables):
    return me.share_beating_null(me.share_fit(t.fits, "class", "obs", "pred", ["grp"]))


@query(
    "e2_brier_log_score", "fits", dbl="brier log_score",
    sql="""SELECT count(DISTINCT "row") AS n_rows, sum(power(pred - obs, 2)) / count(DISTINCT "row") AS brier, -sum(obs * ln(pred + 1e-10)) / count(DISTINCT "row") AS log_score FROM fits""",
)
def _(t: Tables):
    return me.brier_log_score(t.fits, "row", "obs", "pred")


@query(
    "e2_row_scores", "fits", dbl="brier log_score tvd mad",
    sql="""SELECT "row", sum(power(pred - obs, 2)) AS brier, -sum(obs * ln(pred + 1e-10)) AS log_score, 0.5 * sum(abs(pred - obs)) AS tvd, avg(abs(pred - obs)) AS mad FROM fits GROUP BY 1""",
)
def _(t: Tables):
    return me.row_scores(t.fits, ["row"], "obs", "pred")


ROLE = f"""rl AS (SELECT *, CASE WHEN {_h(23, '"row"')} % 2 = 0 THEN 'test_random' ELSE 'test_block' END AS role FROM fits)"""


def roles(t: Tables):
    from gridpanel.plans.skew import hash_order

    return t.fits.withColumn("role", F.when(hash_order(23, "row") % 2 == 0, "test_random").otherwise("test_block"))


@query(
    "e3_optimism", "fits", dbl="mcfadden_random mcfadden_block optimism",
    sql=f"""WITH {ROLE}, {cll('role', src='rl')}, f AS (SELECT role, 1 - sum(ll) / sum(l0) AS m FROM cl GROUP BY 1)
        SELECT max(CASE WHEN role = 'test_random' THEN m END) AS mcfadden_random, max(CASE WHEN role = 'test_block' THEN m END) AS mcfadden_block,
        max(CASE WHEN role = 'test_random' THEN m END) - max(CASE WHEN role = 'test_block' THEN m END) AS optimism FROM f""",
)
def _(t: Tables):
    return me.optimism(roles(t), "role", "class", "obs", "pred")


@query(
    "e4_per_class_fit", "fits", dbl="obs pred ratio ll:5 gain_nats:5 share_of_gain:7 corr",
    sql=f"""WITH {cll()} SELECT class, mo AS obs, mp AS pred, mp / greatest(mo, 1e-12) AS ratio, ll, ll - l0 AS gain_nats, (ll - l0) / sum(ll - l0) OVER () AS share_of_gain, c AS corr FROM cl""",
)
def _(t: Tables):
    return me.per_class_fit(t.fits, "class", "obs", "pred")


CALIB = """u AS (SELECT obs, pred FROM fits WHERE pred > 1e-3 OR obs > 1e-3), c AS (SELECT list_distinct(quantile_cont(pred, [i / 12.0 FOR i IN range(13)])) AS cuts FROM u),
    cb AS (SELECT bin, count(*) AS n, avg(pred) AS pred, avg(obs) AS obs, avg(obs) - avg(pred) AS gap FROM (SELECT obs, pred, CAST(greatest(len(list_filter(cuts, lambda v: v < pred)), 1) AS INTEGER) AS bin FROM u, c) GROUP BY 1)"""


@query("e5_calibration", "fits", dbl="pred obs gap", sql=f"WITH {CALIB} SELECT * FROM cb")
def _(t: Tables):
    return me.calibration(t.fits, "obs", "pred")


@query("e5_calibration_gap", "fits", dbl="mean_abs_gap", sql=f"WITH {CALIB} SELECT sum(abs(gap) * n) / sum(n) AS mean_abs_gap FROM cb")
def _(t: Tables):
    return me.calibration_gap(me.calibration(t.fits, "obs", "pred"))


@query(
    "e5_calibration_fixed", "fits", dbl="mean_pred obs_freq",
    sql="SELECT class, CAST(greatest(ceil(pred / 0.1), 1) AS INTEGER) AS bin, avg(pred) AS mean_pred, avg(obs) AS obs_freq, count(*) AS n FROM fits GROUP BY 1, 2",
)
def _(t: Tables):
    return me.calibration_fixed(t.fits, "class", "obs", "pred")


FLAGS = ["A", "N", "R"]


@query(
    "e6_substitution", "fits", dbl="partial_r:6",
    sql="""WITH a AS (SELECT class FROM fits GROUP BY 1 ORDER BY sum(obs) DESC LIMIT 1), w AS (SELECT "row", min(CASE WHEN class <> (SELECT class FROM a) THEN class END) AS k1, max(CASE WHEN class <> (SELECT class FROM a) THEN class END) AS k2,
        arg_min(pred - obs, class) FILTER (class <> (SELECT class FROM a)) AS e1, arg_max(pred - obs, class) FILTER (class <> (SELECT class FROM a)) AS e2 FROM fits GROUP BY 1),
        r AS (SELECT max(k1) AS k1, max(k2) AS k2, corr(e1, e2) / (1 + 1e-6) AS r FROM w)
        SELECT k1 AS class, CASE WHEN r < 0 THEN k2 ELSE k1 END AS partner, least(r, 0) AS partial_r, (SELECT class FROM a) AS left_out FROM r UNION ALL SELECT k2, CASE WHEN r < 0 THEN k1 ELSE k2 END, least(r, 0), (SELECT class FROM a) FROM r""",
)
def _(t: Tables):
    return me.substitution(t.fits, ["row"], "class", "obs", "pred", FLAGS)


BASE = "bs AS (SELECT *, avg(obs) OVER (PARTITION BY class) * 0.9 + 0.1 / 3 AS base FROM fits)"


def with_base(t: Tables):
    mean = t.fits.groupBy("class").agg((F.avg("obs") * 0.9 + 0.1 / 3).alias("base"))
    return t.fits.join(mean, "class")


@query(
    "e7_re_gain", "fits", dbl="log_lik:5 mcfadden gain_nats:5",
    sql=f"""WITH {BASE}, lg AS (SELECT 'pooled' AS model, class, obs, base AS p FROM bs UNION ALL SELECT 'full', class, obs, pred FROM bs), {cll('model', 'p', 'lg')}, f AS (SELECT model, sum(ll) AS l, sum(l0) AS z FROM cl GROUP BY 1)
        SELECT model, l AS log_lik, 1 - l / z AS mcfadden, l - (SELECT l FROM f WHERE model = 'pooled') AS gain_nats FROM f""",
)
def _(t: Tables):
    return me.re_gain(with_base(t), "class", "obs", "base", "pred")


@query(
    "e8_compare_fits", "fits", dbl="obs ll_a:5 ll_b:5 d_ll:5",
    sql=f"""WITH {BASE} SELECT class, avg(obs) AS obs, sum(obs * ln(greatest(base, 1e-12))) AS ll_a, sum(obs * ln(greatest(pred, 1e-12))) AS ll_b,
        sum(obs * ln(greatest(pred, 1e-12))) - sum(obs * ln(greatest(base, 1e-12))) AS d_ll, avg(obs) < 0.334 AS rare FROM bs GROUP BY 1""",
)
def _(t: Tables):
    b = with_base(t)
    return me.compare_fits(b.select("row", "class", "obs", F.col("base").alias("p")), b.select("row", "class", F.col("pred").alias("p")), ["row"], "class", "obs", "p", 0.334)


@query("e9_mad_tvd", "fits", dbl="mad mean_tvd", sql='SELECT avg(abs(pred - obs)) AS mad, 0.5 * sum(abs(pred - obs)) / count(DISTINCT "row") AS mean_tvd FROM fits')
def _(t: Tables):
    return me.mad_tvd(t.fits, "row", "obs", "pred")


COUNTS = """ct AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, q AS obs, 60 + o_totalprice / 1e4 AS pred FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


@query(
    "e10_count_fit", dbl="cor cor_log r2_log obs_total pred_total:4",
    sql=f"""WITH {COUNTS} SELECT year, count(*) AS n, corr(obs, pred) AS cor, corr(ln(1 + obs), ln(1 + pred)) AS cor_log, 1 - sum(power(ln(1 + obs) - ln(1 + pred), 2)) / (var_pop(ln(1 + obs)) * count(*)) AS r2_log,
        sum(obs) AS obs_total, sum(pred) AS pred_total FROM ct GROUP BY 1""",
)
def _(t: Tables):
    q = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("obs"))
    src = t.orders.join(q, "o_orderkey").select(F.year("o_orderdate").alias("year"), "obs", (F.lit(60.0) + F.col("o_totalprice") / 1e4).alias("pred"))
    return me.count_fit(src, "obs", "pred", ["year"])


@query(
    "e11_waic", "draws design", dbl="lppd:5 p_waic:6 waic:4 se:5",
    sql=f"""WITH {WIDE}, pl AS (SELECT "row", {" + ".join(f"x2 * (u{i} * 0.2) - exp(u{i} * 0.2) - lgamma(x2 + 1)" for i in range(4))} AS ll FROM wu), mx AS (SELECT "row", max(ll) AS m FROM pl GROUP BY 1),
        pw AS (SELECT "row", max(m) + ln(avg(exp(ll - m))) AS lpd, var_samp(ll) AS p FROM pl JOIN mx USING ("row") GROUP BY 1) SELECT count(*) AS n, sum(lpd) AS lppd, sum(p) AS p_waic, -2 * sum(lpd - p) AS waic, 2 * sqrt(count(*) * var_samp(lpd - p)) AS se FROM pw""",
)
def _(t: Tables):
    return me.waic_of_moments(ds.pointwise_moments(rows(t), model(t), ["row"], "grp", 4, me.poisson_draws("x2", 0.2), ["x2"]))


@query(
    "e12_pointwise_loglik", dbl="nb:7 poisson:7",
    sql="""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lgamma(y + 1.5) - lgamma(1.5) - lgamma(y + 1) + y * e - (y + 1.5) * ln(1 + exp(e)) AS nb, y * e - exp(e) - lgamma(y + 1) AS poisson
        FROM (SELECT *, l_quantity AS y, l_extendedprice / 1e5 + 1 AS e FROM lineitem)""",
)
def _(t: Tables):
    y, e = F.col("l_quantity"), F.col("l_extendedprice") / 1e5 + 1
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", me.nb_loglik(y, e, F.lit(1.5)).alias("nb"), me.poisson_loglik(y, e).alias("poisson")
    )


@query("e12_multinomial_loglik", "fits", dbl="ll", sql='SELECT "row", sum(obs * ln(greatest(pred, 1e-12))) AS ll FROM fits GROUP BY 1')
def _(t: Tables):
    return me.multinomial_loglik(t.fits, ["row"], "obs", "pred")


@query(
    "e13_design_summary", "design lu",
    sql="""SELECT 'rows' AS item, CAST(count(*) AS VARCHAR) AS value FROM design UNION ALL SELECT 'groups', CAST(count(DISTINCT grp) AS VARCHAR) FROM design UNION ALL SELECT 'covariates', '4'
        UNION ALL SELECT 'classes', CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT class FROM lu) UNION ALL SELECT 'rare_classes', CAST(count(CASE WHEN s < 0.165 THEN 1 END) AS VARCHAR) FROM (SELECT class, sum(area) / sum(sum(area)) OVER () AS s FROM lu GROUP BY 1)
        UNION ALL SELECT 'largest_class', arg_max(class, a) FROM (SELECT class, sum(area) AS a FROM lu GROUP BY 1)""",
)
def _(t: Tables):
    return me.design_summary(t.design, t.lu, "grp", "class", "area", 4, rare=0.165)


@query("e14_validate_loglik", "fits", dbl="a:5 b:5 rel_gap", sql=f"WITH {cll('grp')} SELECT grp, sum(ll) AS a, sum(ll) * 1.0000001 AS b, 1e-7 / 1.0000001 AS rel_gap, true AS ok FROM cl GROUP BY 1 HAVING abs(sum(ll)) > 1")
def _(t: Tables):
    fit = me.share_fit(t.fits, "class", "obs", "pred", ["grp"]).select("grp", F.col("ll").alias("a"), (F.col("ll") * 1.0000001).alias("b"))
    return me.validate_loglik(fit, "a", "b", ["grp"])


@query(
    "e15_dominant_table", "fits",
    sql="""SELECT *, dominant_obs = dominant_pred AS agree FROM (SELECT "row", arg_min(class, (-obs, class)) AS dominant_obs, arg_min(class, (-pred, class)) AS dominant_pred FROM fits GROUP BY 1)""",
)
def _(t: Tables):
    return me.dominant_table(t.fits, ["row"], "class", "obs", "pred")


@query(
    "e16_clip_quantile", dbl="bal:6",
    sql="WITH c AS (SELECT quantile_cont(abs(c_acctbal), 0.95) AS q FROM customer) SELECT c_custkey, greatest(least(c_acctbal, q), -q) AS bal FROM customer, c",
)
def _(t: Tables):
    return me.clip_quantile(t.customer, "c_acctbal", 0.95, "bal").select("c_custkey", "bal")


@query("e16_average_over_groups", "draws", dbl="mean sd", sql="SELECT cov, class, avg(v) AS mean, stddev_samp(v) AS sd, count(*) AS n FROM (SELECT cov, class, grp, avg(value) AS v FROM draws GROUP BY 1, 2, 3) GROUP BY 1, 2")
def _(t: Tables):
    return me.average_over_groups(t.draws.groupBy("cov", "class", "grp").agg(F.avg("value").alias("v")), ["cov", "class"], "v")


