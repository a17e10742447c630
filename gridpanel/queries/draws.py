"""Draw-table analytics and convergence."""

from __future__ import annotations


from pyspark.sql import functions as F

from gridpanel.operators import draws as dr
from gridpanel.operators import drawstore as ds
from gridpanel.operators import estimate as es
from gridpanel.operators import score as so
from gridpanel.operators.windows import autocovariance
from gridpanel.queries.base import Tables, query
from gridpanel.queries.design import COVS
from gridpanel.queries.scoring import CLASSES, WIDE, icdf_sql, model, rows, soft, unpivoted


@query(
    "g1_summarise_draws", "draws", dbl="mean sd p_direction q025 median q975",
    sql="""SELECT *, q025 > 0 OR q975 < 0 AS sign_excludes_zero FROM (SELECT param, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd,
        greatest(avg(CASE WHEN value > 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN value < 0 THEN 1.0 ELSE 0 END)) AS p_direction,
        quantile_cont(value, 0.025) AS q025, median(value) AS median, quantile_cont(value, 0.975) AS q975 FROM draws GROUP BY 1)""",
)
def _(t: Tables):
    return dr.summarise_draws(t.draws, ["param"])


@query(
    "g1_summarise_bounded", "draws", dbl="mean sd p_direction q025 median q975",
    sql="""SELECT *, q025 > 0 OR q975 < 0 AS sign_excludes_zero FROM (SELECT param, chain, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd,
        greatest(avg(CASE WHEN value > 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN value < 0 THEN 1.0 ELSE 0 END)) AS p_direction,
        quantile_cont(value, 0.025) AS q025, median(value) AS median, quantile_cont(value, 0.975) AS q975 FROM th2 GROUP BY 1, 2)""".replace(
        "FROM th2", "FROM (SELECT * FROM (SELECT *, max(iter) OVER (PARTITION BY param, chain) AS mx FROM draws) WHERE (iter - 1) % greatest(1, CAST(ceil(mx / 40.0) AS BIGINT)) = 0)"
    ),
)
def _(t: Tables):
    from gridpanel.operators.split import thin

    return dr.summarise_draws(thin(t.draws, ["param", "chain"], "iter", 40), ["param", "chain"], bounded=True)


@query(
    "g2_visible", "draws", dbl="mean lo hi",
    sql="SELECT *, sign(lo) = sign(hi) AS visible FROM (SELECT cov, class, avg(value) AS mean, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM draws GROUP BY 1, 2)",
)
def _(t: Tables):
    return dr.visible(t.draws, ["cov", "class"])


@query(
    "g3_combine_chains", "draws", dbl="value",
    sql="""SELECT param, iter + s AS iter, value FROM draws JOIN (SELECT chain, coalesce(sum(m) OVER (ORDER BY chain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
        FROM (SELECT chain, max(iter) AS m FROM draws GROUP BY 1)) USING (chain)""".replace("iter + s AS iter", "CAST(iter + s AS BIGINT) AS iter"),
)
def _(t: Tables):
    chains = {c: t.draws.where(F.col("chain") == c).select("param", "iter", "value") for c in range(10)}
    return dr.combine_chains(chains, keep_chain=False)


RHAT = """SELECT param, n_chains, n, CASE WHEN n_chains > 1 AND w > 0 THEN sqrt(((n - 1) / n * w + b) / w) END AS rhat FROM (SELECT param, count(*) AS n_chains, avg(n) AS n, avg(v) AS w, var_samp(m) AS b
    FROM (SELECT param, chain, count(*) AS n, avg({x}) AS m, var_samp({x}) AS v FROM {src} GROUP BY 1, 2) GROUP BY 1)"""


@query("g4_rhat", "draws", dbl="n rhat", sql=RHAT.format(x="value", src="draws"))
def _(t: Tables):
    return dr.rhat(t.draws, ["param"])


HALVES = """hv AS (SELECT param, chain || CASE WHEN iter > n - h THEN '|b' ELSE '|a' END AS chain, CASE WHEN iter > n - h THEN iter - (n - h) ELSE iter END AS iter, value
    FROM (SELECT *, n // 2 AS h FROM (SELECT *, max(iter) OVER (PARTITION BY param, chain) AS n FROM draws)) WHERE iter <= h OR iter > n - h)"""


def _zrank(src: str, x: str) -> str:
    ranked = (
        f"SELECT *, (rk + (tn - 1) / 2.0 - 0.375::DOUBLE) / (sn + 0.25) AS v FROM (SELECT *, rank() OVER (PARTITION BY param ORDER BY {x}) AS rk, "
        f"count(*) OVER (PARTITION BY param, {x}) AS tn, count(*) OVER (PARTITION BY param) AS sn FROM {src})"
    )
    return icdf_sql(ranked)


@query(
    "g5_rhat_rank", "draws", dbl="rhat",
    sql=f"""WITH {HALVES}, z1 AS ({_zrank('hv', 'value')}), fo AS (SELECT hv.*, abs(value - m) AS f FROM hv JOIN (SELECT param, median(value) AS m FROM hv GROUP BY 1) USING (param)), z2 AS ({_zrank('fo', 'f')})
        SELECT param, greatest(a.rhat, b.rhat) AS rhat FROM ({RHAT.format(x='z', src='z1')}) a JOIN ({RHAT.format(x='z', src='z2')}) b USING (param)""",
)
def _(t: Tables):
    return dr.rhat_rank(t.draws, ["param"])


def _ess_sql(src: str, x: str, tag: str) -> str:
    """CTEs for the multi-chain effective size of column ``x`` of ``src``; the last one is ``es_<tag>``."""
    return f"""c_{tag} AS (SELECT param, chain, iter, {x} - avg({x}) OVER (PARTITION BY param, chain) AS d, count(*) OVER (PARTITION BY param, chain) AS n FROM {src}),
    l_{tag} AS (SELECT CAST(unnest(range(0, 101)) AS INTEGER) AS lag),
    k_{tag} AS (SELECT param, chain, lag, max(n) AS n FROM c_{tag} CROSS JOIN l_{tag} GROUP BY 1, 2, 3),
    a_{tag} AS (SELECT a.param, a.chain, b.iter - a.iter AS lag, sum(a.d * b.d) / max(a.n) AS ac FROM c_{tag} a JOIN c_{tag} b ON a.param = b.param AND a.chain = b.chain AND b.iter - a.iter BETWEEN 0 AND 100 GROUP BY 1, 2, 3),
    m_{tag} AS (SELECT param, lag, avg(coalesce(ac, 0)) AS ac, avg(n) AS n, sum(n) AS s FROM k_{tag} LEFT JOIN a_{tag} USING (param, chain, lag) GROUP BY 1, 2),
    v_{tag} AS (SELECT param, var_samp(mu) AS vm FROM (SELECT param, chain, avg({x}) AS mu FROM {src} GROUP BY 1, 2) GROUP BY 1),
    r_{tag} AS (SELECT m.param, lag, m.n, m.s, CASE WHEN lag = 0 THEN 1.0 ELSE 1 - (w - ac * m.n / (m.n - 1)) / nullif(w * (m.n - 1) / m.n + vm, 0) END AS rho FROM m_{tag} m JOIN v_{tag} USING (param)
        JOIN (SELECT param, ac * n / (n - 1) AS w FROM m_{tag} WHERE lag = 0) USING (param) WHERE lag < m.n),
    p_{tag} AS (SELECT param, lag // 2 AS t, max(n) AS n, max(s) AS s, sum(rho) AS p FROM r_{tag} GROUP BY 1, 2 HAVING count(*) = 2),
    q_{tag} AS (SELECT *, min(p) OVER (PARTITION BY param ORDER BY t) AS mono, min(CASE WHEN p <= 0 THEN t END) OVER (PARTITION BY param) AS stop FROM p_{tag}),
    es_{tag} AS (SELECT param, max(s) / greatest(-1 + 2 * coalesce(sum(CASE WHEN t < coalesce(stop, 9999) THEN mono END), 0), 1 / log10(max(s))) AS ess, max(stop) IS NULL AS lag_limited FROM q_{tag} GROUP BY 1)"""


@query("g5_ess_bulk", "draws", dbl="ess:6", sql=f"WITH {HALVES}, z1 AS ({_zrank('hv', 'value')}), {_ess_sql('z1', 'z', 'b')} SELECT * FROM es_b")
def _(t: Tables):
    return dr.ess_bulk(t.draws.select("param", "chain", "iter", "value"), ["param"])


@query(
    "g5_ess_tail", "draws", dbl="ess:6",
    sql=f"""WITH {HALVES}, qc AS (SELECT param, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM hv GROUP BY 1),
        il AS (SELECT param, chain, iter, CASE WHEN value <= lo THEN 1.0 ELSE 0 END::DOUBLE AS i FROM hv JOIN qc USING (param)), ih AS (SELECT param, chain, iter, CASE WHEN value <= hi THEN 1.0 ELSE 0 END::DOUBLE AS i FROM hv JOIN qc USING (param)),
        {_ess_sql('il', 'i', 'lo')}, {_ess_sql('ih', 'i', 'hi')} SELECT param, least(a.ess, b.ess) AS ess, a.lag_limited OR b.lag_limited AS lag_limited FROM es_lo a JOIN es_hi b USING (param)""",
)
def _(t: Tables):
    return dr.ess_tail(t.draws.select("param", "chain", "iter", "value"), ["param"])


ACOV = """ct AS (SELECT param, chain, iter, value - avg(value) OVER (PARTITION BY param, chain) AS d, count(*) OVER (PARTITION BY param, chain) AS n FROM draws),
    ac AS (SELECT a.param, a.chain, CAST(b.iter - a.iter AS INTEGER) AS lag, sum(a.d * b.d) / max(a.n) AS acov, max(a.n) AS n FROM ct a JOIN ct b ON a.param = b.param AND a.chain = b.chain AND b.iter - a.iter BETWEEN 0 AND 50 GROUP BY 1, 2, 3)"""


@query("w10_autocovariance", "draws", dbl="acov", sql=f"WITH {ACOV} SELECT * FROM ac WHERE lag <= 20")
def _(t: Tables):
    return autocovariance(t.draws, ["param", "chain"], "iter", "value", 20, block=32)


ESS = f"""{ACOV}, rh AS (SELECT a.param, a.chain, a.lag, a.n, a.acov / z.acov AS rho FROM ac a JOIN ac z ON z.param = a.param AND z.chain = a.chain AND z.lag = 0 WHERE a.lag BETWEEN 1 AND least(50, a.n // 4)),
    kk AS (SELECT param, chain, max(n) AS n, coalesce(min(CASE WHEN rho < 0.05 THEN lag END), count(*)) AS k FROM rh GROUP BY 1, 2),
    ee AS (SELECT param, sum(n / (1 + 2 * s)) AS ess FROM (SELECT param, chain, kk.n, sum(rho) AS s FROM rh JOIN kk USING (param, chain) WHERE lag <= greatest(1, k - 1) GROUP BY 1, 2, 3) GROUP BY 1)"""


@query("g6_ess", "draws", dbl="ess", sql=f"WITH {ESS} SELECT * FROM ee")
def _(t: Tables):
    return dr.ess(t.draws, ["param"])


@query(
    "g7_convergence_table", "draws", dbl="rhat_max frac_bad ess_min rhat_med ess_med",
    sql=f"""WITH {ESS}, dg AS (SELECT 'x' || (param // 16) AS block, rhat, ess FROM ({RHAT.format(x='value', src='draws')}) JOIN ee USING (param))
        SELECT block, count(*) AS n, max(rhat) AS rhat_max, avg(CASE WHEN rhat > 1.05 THEN 1.0 ELSE 0 END) AS frac_bad, min(ess) AS ess_min, median(rhat) AS rhat_med, median(ess) AS ess_med, false AS missing FROM dg GROUP BY 1
        UNION ALL SELECT 'sigma', 0, NULL, NULL, NULL, NULL, NULL, true""",
)
def _(t: Tables):
    diag = dr.rhat(t.draws, ["cov", "param"]).join(dr.ess(t.draws, ["cov", "param"]), ["cov", "param"]).withColumnRenamed("cov", "block")
    return dr.convergence_table(diag, "block", expected=["x0", "x1", "x2", "x3", "sigma"])


CONTRAST = """SELECT {k}, a.class AS from_class, b.class AS to_class, quantile_cont(b.value - a.value, 0.025) AS q025, median(b.value - a.value) AS median, quantile_cont(b.value - a.value, 0.975) AS q975
    FROM {src} a JOIN {src} b USING ({k}, chain, iter) WHERE a.class <> b.class GROUP BY ALL"""


@query("g8_contrasts", "draws", dbl="q025 median q975", sql=CONTRAST.format(k="cov, grp", src="draws"))
def _(t: Tables):
    return dr.contrasts(t.draws, ["cov", "grp"], ["chain", "iter"], "class", "value", CLASSES)


@query(
    "g8_contrast_table", "pooled draws design", dbl="q025 median q975 sd_x",
    sql=f"""WITH ct AS ({CONTRAST.format(k='cov, grp', src='draws')}), cp AS ({CONTRAST.format(k='cov', src='pooled')}), al AS (SELECT *, false AS pooled FROM ct UNION ALL SELECT cov, 'g4', from_class, to_class, q025, median, q975, true FROM cp)
        SELECT cov, grp, from_class, to_class, CASE WHEN cov = 'x3' THEN 0.0 ELSE q025 END AS q025, CASE WHEN cov = 'x3' THEN 0.0 ELSE median END AS median, CASE WHEN cov = 'x3' THEN 0.0 ELSE q975 END AS q975, pooled,
        CASE cov WHEN 'x1' THEN (SELECT stddev_samp(x1) FROM design) WHEN 'x2' THEN (SELECT stddev_samp(x2) FROM design) ELSE 1.0 END AS sd_x FROM al""",
)
def _(t: Tables):
    from gridpanel.operators.design import display_sds

    fit = dr.contrasts(t.draws, ["cov", "grp"], ["chain", "iter"], "class", "value", CLASSES)
    mu = dr.contrasts(t.pooled, ["cov"], ["chain", "iter"], "class", "value", CLASSES)
    return dr.contrast_table(fit, mu, t.design.select("grp"), "cov", "grp", display_sds(t.design, COVS), zero=["x3"])


@query("g9_zero_sum", "pooled draws", dbl="value", sql="SELECT cov, class, chain, iter, value - avg(value) OVER (PARTITION BY cov, chain, iter) AS value FROM pooled")
def _(t: Tables):
    return dr.to_zero_sum(t.pooled, ["cov", "chain", "iter"])


@query(
    "g9_expand_baseline", "pooled draws", dbl="value",
    sql="""WITH a AS (SELECT cov, chain, iter, class, value FROM pooled UNION ALL SELECT DISTINCT cov, chain, iter, 'base', 0.0::DOUBLE FROM pooled) SELECT cov, class, chain, iter, value - avg(value) OVER (PARTITION BY cov, chain, iter) AS value FROM a""",
)
def _(t: Tables):
    return dr.expand_baseline(t.pooled, ["cov", "chain", "iter"], "class", "value", "base")


@query(
    "g9_restore_reference", "pooled draws", dbl="value",
    sql="SELECT class, chain, iter, cov, value FROM pooled UNION ALL SELECT class, chain, iter, 'x9', -sum(value) FROM pooled WHERE cov IN ('x1', 'x2') GROUP BY 1, 2, 3",
)
def _(t: Tables):
    return dr.restore_reference(t.pooled, ["class", "chain", "iter"], "cov", "value", ["x1", "x2"], "x9")


@query(
    "g10_integrate_years", "pooled draws", dbl="value",
    sql="""SELECT class, chain, iter, CASE WHEN cov IN ('x0', 'x2', 'x3') THEN 'intercept' ELSE cov END AS cov, sum(CASE WHEN cov IN ('x2', 'x3') THEN value / 3 ELSE value END) AS value FROM pooled GROUP BY 1, 2, 3, 4""",
)
def _(t: Tables):
    src = t.pooled.withColumn("cov", F.when(F.col("cov") == "x0", "intercept").otherwise(F.col("cov")))
    return dr.integrate_years(src, ["class", "chain", "iter"], "cov", "value", ["x2", "x3"], 3)


MEANS = """gm AS (SELECT grp, (a - avg(a) OVER ()) / stddev_samp(a) OVER () AS m1, (b - avg(b) OVER ()) / stddev_samp(b) OVER () AS m2 FROM (SELECT grp, avg(x1) AS a, avg(x2) AS b FROM design GROUP BY 1)),
    dp AS (SELECT d.grp, d.class, chain, iter, p0.value AS mu, d.value - p0.value AS u, m1 * p1.value + m2 * p2.value AS contextual FROM draws d JOIN pooled p0 USING (class, chain, iter) JOIN pooled p1 USING (class, chain, iter)
        JOIN pooled p2 USING (class, chain, iter) JOIN gm ON gm.grp = d.grp WHERE d.cov = 'x0' AND p0.cov = 'x0' AND p1.cov = 'x1' AND p2.cov = 'x2'),
    dc AS (SELECT grp, class, avg(mu) AS mu, avg(contextual) AS contextual, avg(u) AS u, avg(mu + u + contextual) AS total, quantile_cont(mu + u + contextual, 0.025) AS total_lo, quantile_cont(mu + u + contextual, 0.975) AS total_hi FROM dp GROUP BY 1, 2)"""


def _decomposed(t: Tables):
    from gridpanel.operators.design import group_mean_design

    means = group_mean_design(t.design, "grp", ["x1", "x2"]).table
    return dr.decompose(t.pooled, t.draws, means, ["chain", "iter"], "cov", "class", "grp", "x0", {"_x_x1": "x1", "_x_x2": "x2"})


@query(
    "g11_decompose", "pooled draws design", dbl="mu contextual u total total_lo total_hi share_contextual",
    sql=f"WITH {MEANS} SELECT *, abs(contextual) / (abs(contextual) + abs(u)) AS share_contextual FROM dc",
)
def _(t: Tables):
    return _decomposed(t)


@query(
    "g11_variance_explained", "pooled draws design", dbl="var_total:10 var_contextual:10 var_resid:10 explained:7",
    sql=f"""WITH {MEANS} SELECT class, var_samp(total) AS var_total, var_samp(contextual) AS var_contextual, var_samp(u) AS var_resid, 1 - var_samp(u) / var_samp(total) AS explained FROM dc GROUP BY 1""",
)
def _(t: Tables):
    return dr.variance_explained(_decomposed(t), "class")


@query(
    "g12_population_effect", "pooled draws design", dbl="mu theta_w sd q_lo q_hi frac_pos",
    sql="""WITH w AS (SELECT grp, count(*) / sum(count(*)) OVER () AS w FROM design WHERE grp <> 'g4' GROUP BY 1), th AS (SELECT cov, chain, iter, sum(value * w) AS th FROM draws JOIN w USING (grp) WHERE class = 'c0' GROUP BY 1, 2, 3),
        m AS (SELECT cov, avg(value) AS mu FROM pooled WHERE class = 'c0' GROUP BY 1), f AS (SELECT cov, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END) AS frac_pos FROM (SELECT cov, grp, avg(value) AS v FROM draws WHERE class = 'c0' GROUP BY 1, 2) GROUP BY 1)
        SELECT cov, mu, avg(th) AS theta_w, stddev_samp(th) AS sd, quantile_cont(th, 0.025) AS q_lo, quantile_cont(th, 0.975) AS q_hi, frac_pos FROM th JOIN m USING (cov) JOIN f USING (cov) GROUP BY cov, mu, frac_pos""",
)
def _(t: Tables):
    target = F.col("class") == "c0"
    total = t.draws.where(target)
    weights = t.design.groupBy("grp").agg(F.count(F.lit(1)).alias("weight")).join(total.select("grp").distinct(), "grp", "left_semi")
    return dr.population_effect(total, t.pooled.where(target), weights, "cov", "grp", ["chain", "iter"])


@query(
    "g13_group_deviation", "pooled draws", dbl="re_rms intercept_rms intercept_share",
    sql="""WITH d AS (SELECT grp, cov, power(b - m, 2) AS d2 FROM (SELECT grp, cov, class, avg(value) AS b FROM draws GROUP BY 1, 2, 3) JOIN (SELECT cov, class, avg(value) AS m FROM pooled GROUP BY 1, 2) USING (cov, class))
        SELECT grp, sqrt(avg(d2)) AS re_rms, sqrt(avg(d2) FILTER (cov = 'x0')) AS intercept_rms, sum(d2) FILTER (cov = 'x0') / sum(d2) AS intercept_share FROM d GROUP BY 1""",
)
def _(t: Tables):
    return dr.group_deviation(t.draws, t.pooled, "cov", "class", "grp", intercept="x0")


@query(
    "g13_deviation_by_covariate", "pooled draws", dbl="rms",
    sql="""WITH d AS (SELECT grp, cov, sqrt(avg(power(b - m, 2))) AS rms FROM (SELECT grp, cov, class, avg(value) AS b FROM draws GROUP BY 1, 2, 3) JOIN (SELECT cov, class, avg(value) AS m FROM pooled GROUP BY 1, 2) USING (cov, class) GROUP BY 1, 2)
        SELECT * FROM d WHERE cov IN (SELECT cov FROM d GROUP BY 1 ORDER BY avg(rms) DESC, cov LIMIT 2)""",
)
def _(t: Tables):
    return dr.deviation_by_cov(t.draws, t.pooled, "cov", "class", "grp", 2)


@query(
    "g14_credibility", "draws", dbl="p_sign credibility",
    sql="""SELECT cov, class, p AS p_sign, greatest((p - 0.5) * 2, 0) AS credibility FROM (SELECT cov, class, CASE WHEN cov = 'x3' THEN 0.5 ELSE greatest(avg(CASE WHEN value > 0 THEN 1.0 ELSE 0 END), 1 - avg(CASE WHEN value > 0 THEN 1.0 ELSE 0 END)) END AS p FROM draws GROUP BY 1, 2)""",
)
def _(t: Tables):
    return dr.credibility(t.draws, ["cov", "class"], inert=["x3"], cov="cov")


@query(
    "g15_lambda_summary", "pooled draws", dbl="lambda_q025 lambda lambda_q975",
    sql="""SELECT *, lambda > 0 AND lambda <= 1 AS in_unit_interval FROM (SELECT class, quantile_cont(value * 4 / 3, 0.025) AS lambda_q025, median(value * 4 / 3) AS "lambda", quantile_cont(value * 4 / 3, 0.975) AS lambda_q975 FROM pooled WHERE cov = 'x1' GROUP BY 1)""".replace("lambda > 0 AND lambda <= 1", '"lambda" > 0 AND "lambda" <= 1'),
)
def _(t: Tables):
    return dr.lambda_summary(t.pooled.where(F.col("cov") == "x1"), ["class"], F.lit(4.0))


@query(
    "g15_iv_r2", "design", dbl="r2:7",
    sql="""SELECT iv, (a * a + b * b - 2 * a * b * c) / (1 - c * c) AS r2 FROM (SELECT 'x3' AS iv, corr(x3, x1) AS a, corr(x3, x2) AS b, corr(x1, x2) AS c FROM design UNION ALL SELECT 'iv', corr(x1 + x3, x1), corr(x1 + x3, x2), corr(x1, x2) FROM design)""",
)
def _(t: Tables):
    return dr.iv_r2(t.design.withColumn("iv", F.col("x1") + F.col("x3")), ["x1", "x2"], ["x3", "iv"])


@query(
    "g16_field_moments", "design", dbl="field_0 high low",
    sql='SELECT "row", (x1 + x2) / 2 AS field_0, (x1 + x2) / 2 + sqrt(3.0) * abs(x1 - x2) / sqrt(2.0) AS high, (x1 + x2) / 2 - sqrt(3.0) * abs(x1 - x2) / sqrt(2.0) AS low FROM design',
)
def _(t: Tables):
    fields, _, _ = dr.field_moments(t.design, ["x1", "x2"], 1)
    return fields.select("row", "field_0", F.greatest("field_1p", "field_1m").alias("high"), F.least("field_1p", "field_1m").alias("low"))


@query(
    "g17_shrinkage", "draws", dbl="threshold pct",
    sql="""WITH c AS (SELECT param, avg(value) * 20 AS v FROM draws GROUP BY 1) SELECT t AS threshold, count(CASE WHEN abs(v) > t THEN 1 END) AS n_above, count(*) AS n, round(100.0::DOUBLE * count(CASE WHEN abs(v) > t THEN 1 END) / count(*), 1) AS pct
        FROM c CROSS JOIN (SELECT unnest([1.0, 0.5, 0.1, 0.05, 0.01, 0.001])::DOUBLE AS t) GROUP BY 1""",
)
def _(t: Tables):
    return dr.shrinkage_summary(t.draws.groupBy("param").agg((F.avg("value") * 20).alias("v")), "v")


@query(
    "g17_effective_parameters", "draws", dbl="p_eff",
    sql="""WITH k AS (SELECT cov, param, 1 / (1 + exp(-avg(value) * 40)) AS kappa FROM draws GROUP BY 1, 2) SELECT cov, sum(1 - kappa) AS p_eff, count(CASE WHEN kappa < 0.5 THEN 1 END) AS n_active, count(CASE WHEN kappa >= 0.5 THEN 1 END) AS n_shrunk FROM k GROUP BY 1""",
)
def _(t: Tables):
    kappa = t.draws.groupBy("cov", "param").agg((1 / (1 + F.exp(-F.avg("value") * 40))).alias("kappa"))
    return dr.effective_parameters(kappa, ["cov"])


@query(
    "g18_predicted_totals", "draws design", dbl="est_q025:5 est_median:5 est_q975:5",
    sql=f"""WITH {WIDE}, pd AS (SELECT *, {soft()} FROM wu), ts AS (SELECT grp, chain, iter, {", ".join(f"sum(p{i} * x1) AS t{i}" for i in range(4))} FROM pd GROUP BY 1, 2, 3),
        tt AS (SELECT grp, {unpivoted("t{i}", "t")} FROM ts)
        SELECT grp, class, quantile_cont(t, 0.025) AS est_q025, median(t) AS est_median, quantile_cont(t, 0.975) AS est_q975 FROM tt GROUP BY 1, 2""",
)
def _(t: Tables):
    totals = ds.predictive_totals(rows(t), model(t), "grp", "grp", "x1", CLASSES, ["row"])
    return dr.predicted_totals(totals, ["grp", "class"])


@query("g19_solve_intercepts", "fits", dbl="fitted:6", sql="SELECT grp, class, avg(obs) AS fitted FROM fits GROUP BY 1, 2")
def _(t: Tables):
    names = ["A", "N", "R"]
    pick = lambda c: F.array(*[F.max(F.when(F.col("class") == n, F.col(c))) for n in names])
    src = t.fits.groupBy("grp", "row").agg(F.transform(pick("pred"), lambda v: F.log(v) * 3).alias("u"), pick("obs").alias("y"))
    solved = es.solve_intercepts(src, ["grp"], "u", "y", 3)
    scored = src.join(solved, "grp").withColumn("p", so.softmax(F.zip_with("u", "a", lambda s, a: s + a)))
    return so.explode_classes(scored, ["grp"], "p", names).groupBy("grp", "class").agg(F.avg("p").alias("fitted"))


