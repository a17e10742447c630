"""Fit metrics on long prediction tables: one row per (row, class) with observed and predicted share."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.functions.scalar import lgamma, log_floor
from gridpanel.operators.screens import pair_moments
from gridpanel.operators.windows import fixed_bins, quantile_bins
from gridpanel.plans.skew import group_quantiles, with_group_values
from gridpanel.session import release, written

FLOOR = 1e-12


def class_loglik(df: DataFrame, cls: str, obs: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Per class: rows, means, log-likelihood, null log-likelihood (class mean as prediction), perfect log-likelihood."""
    o, p = F.col(obs), F.col(pred)
    out = df.groupBy(*by, cls).agg(
        F.count(F.lit(1)).alias("n"), F.sum(o).alias("_so"), F.avg(o).alias("obs"), F.avg(p).alias("pred"),
        F.sum(o * log_floor(p, FLOOR)).alias("ll"),
        F.sum(F.when(o > 0, o * F.log(F.when(o > 0, o))).otherwise(0.0)).alias("ll_perfect"),
        F.corr(o, p).alias("corr"),
    )
    return out.withColumn("ll_null", F.col("_so") * log_floor(F.col("obs"), FLOOR)).drop("_so")


def share_fit(df: DataFrame, cls: str, obs: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Log-likelihood, null and perfect log-likelihood, McFadden and normalised fit."""
    per = class_loglik(df, cls, obs, pred, by)
    out = per.groupBy(*by).agg(F.max("n").alias("n"), *[F.sum(c).alias(c) for c in ("ll", "ll_null", "ll_perfect")])
    return out.withColumns({
        "mcfadden": 1 - F.try_divide("ll", "ll_null"),
        "normalised": F.try_divide(F.col("ll") - F.col("ll_null"), F.col("ll_perfect") - F.col("ll_null")),
    })


def share_beating_null(fits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of draws whose log-likelihood exceeds the null's, from a ``share_fit`` by draw."""
    return fits.groupBy(*by).agg(F.avg((F.col("ll") > F.col("ll_null")).cast("double")).alias("share_beating_null"))


def brier_log_score(df: DataFrame, row: str, obs: str, pred: str, eps: float = 1e-10) -> DataFrame:
    """Multinomial Brier score and log score, averaged over rows."""
    d = F.col(pred) - F.col(obs)
    tot = df.agg(
        F.sum(d * d).alias("_b"), F.sum(F.col(obs) * F.log(F.col(pred) + eps)).alias("_l"), F.countDistinct(row).alias("n_rows")
    )
    return tot.select("n_rows", (F.col("_b") / F.col("n_rows")).alias("brier"), (-F.col("_l") / F.col("n_rows")).alias("log_score"))


def row_scores(df: DataFrame, row: Sequence[str], obs: str, pred: str) -> DataFrame:
    """Brier score, log score, total variation distance and mean absolute deviation of every row."""
    d = F.col(pred) - F.col(obs)
    return df.groupBy(*row).agg(
        F.sum(d * d).alias("brier"), (-F.sum(F.col(obs) * F.log(F.col(pred) + 1e-10))).alias("log_score"),
        (F.sum(F.abs(d)) * 0.5).alias("tvd"), F.avg(F.abs(d)).alias("mad"),
    )


def mad_tvd(df: DataFrame, row: str, obs: str, pred: str) -> DataFrame:
    d = F.abs(F.col(pred) - F.col(obs))
    return df.agg(F.avg(d).alias("mad"), (F.sum(d) * 0.5 / F.countDistinct(row)).alias("mean_tvd"))


def optimism(df: DataFrame, role: str, cls: str, obs: str, pred: str, random: str = "test_random", block: str = "test_block") -> DataFrame:
    """Fit on random and on block hold-outs, and the McFadden gap between them."""
    fits = share_fit(df.where(F.col(role).isin(random, block)), cls, obs, pred, [role])
    r = F.max(F.when(F.col(role) == random, F.col("mcfadden")))
    b = F.max(F.when(F.col(role) == block, F.col("mcfadden")))
    return fits.agg(r.alias("mcfadden_random"), b.alias("mcfadden_block"), (r - b).alias("optimism"))


def per_class_fit(df: DataFrame, cls: str, obs: str, pred: str) -> DataFrame:
    """Observed and predicted share, ratio, gain over the null in nats, share of the total gain, correlation."""
    per = class_loglik(df, cls, obs, pred).withColumn("gain_nats", F.col("ll") - F.col("ll_null"))
    total = F.sum("gain_nats").over(Window.partitionBy())  # one row per class
    return per.select(
        cls, "obs", "pred", (F.col("pred") / F.greatest(F.col("obs"), F.lit(FLOOR))).alias("ratio"), "ll", "gain_nats",
        F.try_divide(F.col("gain_nats"), total).alias("share_of_gain"), "corr",
    )


def calibration(df: DataFrame, obs: str, pred: str, bins: int = 12, floor: float = 1e-3) -> DataFrame:
    """Mean prediction and observation per quantile bin; pairs where both are near zero are left out."""
    used = df.where((F.col(pred) > floor) | (F.col(obs) > floor)).select(obs, pred)
    binned = quantile_bins(used, pred, bins)
    out = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(pred).alias("pred"), F.avg(obs).alias("obs"))
    return out.withColumn("gap", F.col("obs") - F.col("pred"))


def calibration_fixed(df: DataFrame, cls: str, obs: str, pred: str, width: float = 0.1) -> DataFrame:
    binned = df.withColumn("bin", fixed_bins(F.col(pred), width))
    return binned.groupBy(cls, "bin").agg(F.avg(pred).alias("mean_pred"), F.avg(obs).alias("obs_freq"), F.count(F.lit(1)).alias("n"))


def calibration_gap(table: DataFrame) -> DataFrame:
    """Weighted mean absolute gap of a calibration table."""
    return table.agg((F.sum(F.abs(F.col("gap")) * F.col("n")) / F.sum("n")).alias("mean_abs_gap"))


def substitution(df: DataFrame, row: Sequence[str], cls: str, obs: str, pred: str, classes: Sequence[str]) -> DataFrame:
    """Closest competing class by partial correlation of residuals.

    The largest class carries the sum-to-one constraint and is left out; a small ridge steadies the inverse.  Second
    moments come from one pass; only the class × class matrix is inverted on the driver.
    """
    err = F.col(pred) - F.col(obs)
    every = {f"_r{i}": c for i, c in enumerate(classes)}
    amounts = [F.sum(F.when(F.col(cls) == c, F.col(obs))).alias(f"_o{i}") for i, c in enumerate(classes)]
    wide = written(df.groupBy(*row).agg(*[F.sum(F.when(F.col(cls) == c, err).otherwise(0.0)).alias(a) for a, c in every.items()], *amounts))
    totals = dict(zip(classes, wide.agg(*[F.sum(f"_o{i}") for i in range(len(classes))]).first(), strict=True))
    anchor = max(classes, key=lambda c: (totals.get(c) or 0.0))
    kept = [c for c in classes if c != anchor]
    cols = {a: c for a, c in every.items() if c != anchor}
    pos = {a: i for i, a in enumerate(cols)}
    corr = np.eye(len(kept))
    for r in pair_moments(wide, list(cols)).collect():
        if r["a"] != r["b"]:
            corr[pos[r["a"]], pos[r["b"]]] = corr[pos[r["b"]], pos[r["a"]]] = r["corr"] or 0.0
    release(wide)
    inv = np.linalg.inv(corr + 1e-6 * np.eye(len(kept)))
    scale = np.sqrt(np.diag(inv))
    partial = -inv / np.outer(scale, scale)
    np.fill_diagonal(partial, 0.0)
    rows = [(c, kept[int(partial[i].argmin())], float(partial[i].min()), anchor) for i, c in enumerate(kept)]
    return df.sparkSession.createDataFrame(rows, "class string, partner string, partial_r double, left_out string")


def re_gain(df: DataFrame, cls: str, obs: str, pooled: str, full: str) -> DataFrame:
    """Fit of the pooled-only and of the full prediction on the same rows, and the gain in nats."""
    rows = F.explode(F.array(
        F.struct(F.lit("pooled").alias("model"), F.col(pooled).alias("_p")), F.struct(F.lit("full").alias("model"), F.col(full).alias("_p"))
    ))
    long = df.select(cls, obs, rows.alias("r")).select(cls, obs, "r.*")
    fits = share_fit(long, cls, obs, "_p", ["model"])
    base = F.max(F.when(F.col("model") == "pooled", F.col("ll"))).over(Window.partitionBy())  # two rows
    return fits.select("model", F.col("ll").alias("log_lik"), "mcfadden", (F.col("ll") - base).alias("gain_nats"))


def compare_fits(a: DataFrame, b: DataFrame, row: Sequence[str], cls: str, obs: str, pred: str, rare: float = 0.02) -> DataFrame:
    """Two models on their common rows: per class observed share, both log-likelihoods, their difference, rare flag."""
    right = b.select(*row, cls, F.col(pred).alias("_pb"))
    both = a.select(*row, cls, F.col(obs).alias("_o"), F.col(pred).alias("_pa")).join(right, [*row, cls])
    out = both.groupBy(cls).agg(
        F.avg("_o").alias("obs"), F.sum(F.col("_o") * log_floor(F.col("_pa"), FLOOR)).alias("ll_a"),
        F.sum(F.col("_o") * log_floor(F.col("_pb"), FLOOR)).alias("ll_b"),
    )
    return out.withColumns({"d_ll": F.col("ll_b") - F.col("ll_a"), "rare": F.col("obs") < rare})


def count_fit(df: DataFrame, obs: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation, correlation and R² on the log1p scale, rows and totals."""
    lo, lp = F.log1p(F.col(obs)), F.log1p(F.greatest(F.col(pred), F.lit(0.0)))
    used = df.where(F.col(obs).isNotNull() & ~F.isnan(obs)).withColumns({"_lo": lo, "_lp": lp})
    out = used.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.corr(obs, pred).alias("cor"), F.corr("_lo", "_lp").alias("cor_log"),
        F.sum((F.col("_lo") - F.col("_lp")) * (F.col("_lo") - F.col("_lp"))).alias("_sse"), F.var_pop("_lo").alias("_v"),
        F.sum(obs).alias("obs_total"), F.sum(pred).alias("pred_total"),
    )
    return out.withColumn("r2_log", 1 - F.try_divide(F.col("_sse"), F.col("_v") * F.col("n"))).drop("_sse", "_v")


# ---- likelihoods -----------------------------------------------------------------------------------------------


def nb_loglik(y: Column, eta: Column, r: Column) -> Column:
    """Negative binomial log-likelihood with natural parameter η and dispersion r; non-finite terms count 0."""
    lp = lgamma(y + r) - lgamma(r) - lgamma(y + 1.0) + y * eta - (y + r) * F.log1p(F.exp(eta))
    return F.when(F.isnan(lp) | (F.abs(lp) == float("inf")), F.lit(0.0)).otherwise(lp)


def poisson_loglik(y: Column, eta: Column) -> Column:
    lp = y * eta - F.exp(eta) - lgamma(y + 1.0)
    return F.when(F.isnan(lp) | (F.abs(lp) == float("inf")), F.lit(0.0)).otherwise(lp)


def multinomial_loglik(df: DataFrame, row: Sequence[str], obs: str, pred: str) -> DataFrame:
    return df.groupBy(*row).agg(F.sum(F.col(obs) * log_floor(F.col(pred), FLOOR)).alias("ll"))


def poisson_draws(y: str, scale: float = 1.0) -> Callable:
    """Log-likelihood of a count under the utilities of every draw, summed over the classes, for ``drawstore.pointwise_moments``."""
    def loglik(values: dict) -> Callable:
        count = values[y]
        constant = np.array([math.lgamma(v + 1.0) for v in count])

        def of(u: np.ndarray) -> np.ndarray:
            if scale != 1.0:
                u *= scale
            ll = count * u.sum(axis=0)
            np.exp(u, out=u)
            for rate in u:
                ll -= rate
            ll -= len(u) * constant
            return ll

        return of

    return loglik


def waic(ll: DataFrame, row: Sequence[str], value: str = "ll") -> DataFrame:
    """lppd, p_waic and WAIC from a stored table of pointwise log-likelihoods by draw, with the standard error of WAIC."""
    src = with_group_values(ll, row, _m=F.max(value))
    return waic_of_moments(src.groupBy(*row).agg(
        (F.max("_m") + F.log(F.avg(F.exp(F.col(value) - F.col("_m"))))).alias("lpd"), F.var_samp(value).alias("p")
    ))


def waic_of_moments(per: DataFrame) -> DataFrame:
    """WAIC from the rows' lpd and p, which ``drawstore.pointwise_moments`` forms without a rows × draws table."""
    return per.withColumn("elpd", F.col("lpd") - F.col("p")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("lpd").alias("lppd"), F.sum("p").alias("p_waic"), (F.sum("elpd") * -2).alias("waic"),
        (2 * F.sqrt(F.count(F.lit(1)) * F.var_samp("elpd"))).alias("se"),
    )


def validate_loglik(df: DataFrame, recomputed: str, stored: str, keys: Sequence[str], tol: float = 1e-6) -> DataFrame:
    """Recomputed against stored log-likelihood per key: relative gap and whether it passes."""
    rel = F.abs(F.col(recomputed) - F.col(stored)) / F.greatest(F.abs(F.col(stored)), F.lit(1.0))
    return df.select(*keys, recomputed, stored, rel.alias("rel_gap"), (rel <= tol).alias("ok"))


# ---- summaries -------------------------------------------------------------------------------------------------


def design_summary(x: DataFrame, y: DataFrame, group: str, cls: str, value: str, n_covariates: int, rare: float = 1e-3) -> DataFrame:
    """Card of a design: rows, groups, covariates, classes, rare classes, largest class."""
    rows = x.agg(F.count(F.lit(1)).cast("string").alias("rows"), F.countDistinct(group).cast("string").alias("groups"))
    sums = y.groupBy(cls).agg(F.sum(value).alias("_a"))
    shares = with_group_values(sums, [], _t=F.sum("_a")).withColumn("_s", F.col("_a") / F.col("_t"))
    classes = shares.agg(
        F.count(F.lit(1)).cast("string").alias("classes"), F.count(F.when(F.col("_s") < rare, 1)).cast("string").alias("rare_classes"),
        F.max_by(cls, "_a").alias("largest_class"),
    )
    r = rows.unpivot([], ["rows", "groups"], "item", "value")
    c = classes.unpivot([], ["classes", "rare_classes", "largest_class"], "item", "value")
    k = x.sparkSession.range(1).select(F.lit("covariates").alias("item"), F.lit(str(n_covariates)).alias("value"))
    return r.unionByName(c).unionByName(k)


def dominant_table(df: DataFrame, row: Sequence[str], cls: str, obs: str, pred: str) -> DataFrame:
    """Dominant observed and predicted class per row; ties go to the first class name."""
    def top(c: str) -> Column:
        return F.min_by(F.col(cls), F.struct((-F.col(c)).alias("v"), F.col(cls).alias("c")))

    out = df.groupBy(*row).agg(top(obs).alias("dominant_obs"), top(pred).alias("dominant_pred"))
    return out.withColumn("agree", F.col("dominant_obs") == F.col("dominant_pred"))


def clip_quantile(df: DataFrame, value: str, prob: float = 0.95, out: str | None = None) -> DataFrame:
    """Clip a column to ± the quantile of its absolute value."""
    sized = df.withColumn("_abs", F.abs(F.col(value)))
    cut = group_quantiles(sized, [], "_abs", {"_cut": prob}).withColumn("_one", F.lit(1))
    joined = sized.withColumn("_one", F.lit(1)).join(cut, "_one").drop("_one", "_abs")
    limited = F.greatest(F.least(F.col(value), F.col("_cut")), -F.col("_cut"))
    return joined.withColumn(out or value, limited).drop("_cut")


def average_over_groups(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and spread of coefficients over groups."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
