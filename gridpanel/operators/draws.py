"""Draw-table analytics on long tables (parameter keys, chain, iter, value)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.functions.scalar import normal_icdf
from gridpanel.operators.joins import class_pairs
from gridpanel.operators.screens import pair_moments
from gridpanel.operators.windows import autocovariance, centred_series, lag_sums
from gridpanel.plans.skew import average_ranks, group_quantiles, join_null_safe, with_group_values
from gridpanel.session import release, written

CI = {"q025": 0.025, "median": 0.5, "q975": 0.975}


# ---- summaries -------------------------------------------------------------------------------------------------


def summarise_draws(draws: DataFrame, by: Sequence[str], value: str = "value", bounded: bool = False) -> DataFrame:
    """Mean, sd, median, 95 % interval, probability of direction and whether the interval excludes zero."""
    v = F.col(value)
    base = draws.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
        F.greatest(F.avg((v > 0).cast("double")), F.avg((v < 0).cast("double"))).alias("p_direction"),
    )
    q = group_quantiles(draws, by, value, CI, bounded)
    return base.join(q, list(by)).withColumn("sign_excludes_zero", (F.col("q025") > 0) | (F.col("q975") < 0))


def visible(draws: DataFrame, by: Sequence[str], value: str = "value", bounded: bool = False) -> DataFrame:
    """Mean, 90 % interval, and whether both ends carry the same sign."""
    q = group_quantiles(draws, by, value, {"lo": 0.05, "hi": 0.95}, bounded)
    mean = draws.groupBy(*by).agg(F.avg(value).alias("mean"))
    return mean.join(q, list(by)).withColumn("visible", F.signum("lo") == F.signum("hi"))


def credibility(draws: DataFrame, by: Sequence[str], value: str = "value", inert: Sequence[str] = (), cov: str | None = None) -> DataFrame:
    """Share of draws on the majority side and its scaling 2(p − ½); inert covariates get ½ and 0."""
    pos = F.count(F.when(F.col(value) > 0, 1))
    p = F.greatest(pos, F.count(value) - pos) / F.count(value)
    out = draws.groupBy(*by).agg(p.alias("p_sign"))
    if inert and cov:
        out = out.withColumn("p_sign", F.when(F.col(cov).isin(*inert), 0.5).otherwise(F.col("p_sign")))
    return out.withColumn("credibility", F.greatest((F.col("p_sign") - 0.5) * 2, F.lit(0.0)))


def combine_chains(chains: dict, keep_chain: bool = True) -> DataFrame:
    """Stack draw tables with a chain label; without it iterations are renumbered chain after chain by the label order."""
    out = None
    for label, df in chains.items():
        part = df.withColumn("chain", F.lit(label))
        out = part if out is None else out.unionByName(part)
    if keep_chain:
        return out
    longest = out.groupBy("chain").agg(F.max("iter").alias("_m"))
    before = Window.orderBy("chain").rowsBetween(Window.unboundedPreceding, -1)  # one row per chain
    shift = longest.select("chain", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_s"))
    return out.join(shift, "chain").withColumn("iter", F.col("iter") + F.col("_s")).drop("_s", "chain")


# ---- convergence -----------------------------------------------------------------------------------------------


def rhat(draws: DataFrame, by: Sequence[str], chain: str = "chain", value: str = "value") -> DataFrame:
    """Classic Rhat √(((n−1)/n·W + B/n) / W); n is the mean chain length when chains differ."""
    per = draws.groupBy(*by, chain).agg(
        F.count(value).alias("_n"), F.avg(value).alias("_m"), F.var_samp(value).alias("_v")
    )
    tot = per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_chains"), F.avg("_n").alias("n"), F.avg("_v").alias("w"), F.var_samp("_m").alias("b_over_n")
    )
    n = F.col("n")
    r = F.sqrt(F.try_divide((n - 1) / n * F.col("w") + F.col("b_over_n"), F.col("w")))
    ok = (F.col("n_chains") > 1) & (F.col("w") > 0)
    return tot.select(*by, "n_chains", "n", F.when(ok, r).alias("rhat"))


def ess(draws: DataFrame, by: Sequence[str], chain: str = "chain", order: str = "iter", value: str = "value", max_lag: int = 50) -> DataFrame:
    """Effective size: per chain n / (1 + 2 Σ ρ) up to the first lag with ρ < 0.05 (lags to n/4 at most 50), summed."""
    acov = autocovariance(draws, [*by, chain], order, value, max_lag)
    used = acov.where((F.col("lag") <= F.least(F.lit(max_lag), F.floor(F.col("n") / 4))))
    per = used.groupBy(*by, chain).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("lag", "acov"))).alias("_a")
    )
    rho = F.transform(F.slice(F.col("_a"), 2, max_lag), lambda e: F.try_divide(e["acov"], F.get(F.col("_a"), F.lit(0))["acov"]))
    per = per.withColumn("_r", rho)
    low = F.array_position(F.transform("_r", lambda r: r < 0.05), F.lit(True))
    k = F.when(low > 0, low).otherwise(F.size("_r"))
    kept = F.slice("_r", F.lit(1), F.greatest(F.lit(1), k - 1).cast("int"))
    total = F.aggregate(kept, F.lit(0.0), lambda s, v: s + v)
    per = per.withColumn("_ess", F.when(F.col("n") >= 8, F.col("n") / (1 + 2 * total)))
    return per.groupBy(*by).agg(F.sum("_ess").alias("ess"))


def split_chains(draws: DataFrame, by: Sequence[str], chain: str, order: str) -> DataFrame:
    """Cut every chain in two halves of equal length (the middle draw of an odd chain goes); halves count from 1."""
    df = with_group_values(draws, [*by, chain], _n=F.max(order))
    half = F.floor(F.col("_n") / 2)
    second = F.col(order) > F.col("_n") - half
    df = df.where((F.col(order) <= half) | second)
    label = F.concat_ws("|", F.col(chain).cast("string"), F.when(second, "b").otherwise("a"))
    at = F.when(second, F.col(order) - (F.col("_n") - half)).otherwise(F.col(order))
    return df.withColumn(chain, label).withColumn(order, at).drop("_n")


def rank_normalise(draws: DataFrame, by: Sequence[str], value: str = "value", out: str = "z") -> DataFrame:
    """Inverse-normal scores of the ranks over all chains of a parameter: Φ⁻¹((r − 3/8) / (S + 1/4))."""
    ranked = average_ranks(draws, by, value, "_r")
    return ranked.withColumn(out, normal_icdf((F.col("_r") - 0.375) / (F.col("_r_n") + 0.25))).drop("_r", "_r_n")


def rhat_rank(draws: DataFrame, by: Sequence[str], chain: str = "chain", order: str = "iter", value: str = "value") -> DataFrame:
    """Rank-normalised split Rhat: the larger of the bulk and the folded value (Vehtari et al. 2021)."""
    halves = split_chains(draws, by, chain, order)
    bulk = rhat(rank_normalise(halves, by, value), by, chain, "z").select(*by, F.col("rhat").alias("_bulk"))
    centre = group_quantiles(halves, by, value, {"_med": 0.5})
    folded = halves.join(centre, list(by)).withColumn("_f", F.abs(F.col(value) - F.col("_med")))
    tail = rhat(rank_normalise(folded, by, "_f"), by, chain, "z").select(*by, F.col("rhat").alias("_tail"))
    return bulk.join(tail, list(by)).select(*by, F.greatest("_bulk", "_tail").alias("rhat"))


FIRST_LAGS = 256  # lags of the first round; each round doubles them
MOST_LAGS = 65_536  # lags of a round at most: a parameter's row holds one number for each


def _pair_sums(rho: Column, start: Column) -> Column:
    """Continue the initial positive, monotone pair sums (sum, last pair, still positive) over an array of autocorrelations."""
    half = F.floor(F.size(rho) / 2).cast("int")
    pairs = F.when(half > 0, F.transform(F.sequence(F.lit(0), half - 1), lambda t: F.get(rho, 2 * t) + F.get(rho, 2 * t + 1)))

    def step(acc, p):
        on = acc["on"] & (p > 0)
        capped = F.least(p, acc["last"])
        return F.struct(
            F.when(on, acc["s"] + capped).otherwise(acc["s"]).alias("s"),
            F.when(on, capped).otherwise(acc["last"]).alias("last"),
            on.alias("on"),
        )

    return F.coalesce(F.aggregate(pairs, start, step), start)


def _multi_chain_ess(draws: DataFrame, by: Sequence[str], chain: str, order: str, value: str) -> DataFrame:
    """Effective size from the autocovariances of all chains of a parameter, without a chain in one task.

    Ranges of lags, each twice as wide as the one before, are added up block by block over the parameters whose pair sums are still positive, until there
    are none. All lags that count do so; a short chain has no covariance at a long lag.
    """
    series = written(centred_series(draws.where(F.col(value).isNotNull()), [*by, chain], order, value, sparse=True))
    lengths = series.groupBy(*by, chain).agg(F.count(F.lit(1)).alias("_n"), F.avg(F.col("_x") * F.col("_x")).alias("_a"), F.max("_m").alias("_m"))
    state = lengths.groupBy(*by).agg(
        F.avg("_n").alias("_n"), F.sum("_n").alias("_s"), F.avg("_a").alias("_a"), F.var_samp("_m").alias("_vm"), F.count(F.lit(1)).alias("_chains")
    )
    n = F.col("_n")
    state = state.withColumn("_w", F.col("_a") * n / (n - 1))
    plus = F.col("_w") * (n - 1) / n + F.when(F.col("_chains") > 1, F.col("_vm")).otherwise(0.0)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(float("inf")).alias("last"), F.lit(True).alias("on"))
    state = written(state.select(*by, "_n", "_s", "_chains", "_w", plus.alias("_plus"), start.alias("_g")))
    low, width = 0, FIRST_LAGS
    lags = F.ceil(n).cast("long")
    while True:
        active = state.where(F.col("_g.on") & (lags >= low + 2))
        if active.isEmpty():
            break
        high = low + width
        sums = lag_sums(join_null_safe(series, active.select(*by), by), [*by, chain], low, high)
        # the lags of a range that occur follow each other from ``low``, so the place in the sorted list tells the lag
        rows = sums.groupBy(*by, "lag").agg(F.sum("acov").alias("_a")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("lag", "_a"))).alias("_l"))
        step = join_null_safe(active, rows, by, "left")
        rho = F.transform(
            F.sequence(F.lit(low).cast("long"), F.least(lags, F.lit(high)) - 1),
            lambda k: F.when(k == 0, F.lit(1.0)).otherwise(
                1 - F.try_divide(F.col("_w") - F.coalesce(F.get(F.col("_l"), (k - low).cast("int"))["_a"], F.lit(0.0)) / F.col("_chains") * n / (n - 1), F.col("_plus"))
            ),
        )
        moved = step.withColumn("_rho", rho).withColumn("_g", _pair_sums(F.col("_rho"), F.col("_g"))).select(*state.columns)
        settled = state.where(~(F.coalesce(F.col("_g.on"), F.lit(False)) & (lags >= low + 2)))
        before, state = state, written(settled.unionByName(moved))
        release(before)
        low, width = high, min(2 * width, MOST_LAGS)
    release(series)
    tau = F.greatest(-1 + 2 * F.col("_g.s"), 1 / F.log10(F.col("_s")))
    return state.select(*by, (F.col("_s") / tau).alias("ess"), F.col("_g.on").alias("lag_limited"))


def ess_bulk(
    draws: DataFrame, by: Sequence[str], chain: str = "chain", order: str = "iter", value: str = "value"
) -> DataFrame:
    """Bulk effective size of rank-normalised split chains.

    All lags of a chain count.  ``lag_limited`` is true when the pair sums were still positive at the last lag: the chains are too short.
    """
    halves = rank_normalise(split_chains(draws, by, chain, order), by, value)
    return _multi_chain_ess(halves, by, chain, order, "z")


def ess_tail(
    draws: DataFrame, by: Sequence[str], chain: str = "chain", order: str = "iter", value: str = "value"
) -> DataFrame:
    """Tail effective size: the smaller one of the 5 % and 95 % indicator series on split chains."""
    halves = split_chains(draws, by, chain, order)
    cuts = group_quantiles(halves, by, value, {"_lo": 0.05, "_hi": 0.95})
    flagged = halves.join(cuts, list(by))
    sides = []
    for c in ("_lo", "_hi"):
        ind = flagged.withColumn("_i", (F.col(value) <= F.col(c)).cast("double")).select(*by, chain, order, "_i")
        sides.append(_multi_chain_ess(ind, by, chain, order, "_i").withColumn("_side", F.lit(c)))
    both = sides[0].unionByName(sides[1])
    return both.groupBy(*by).agg(F.min("ess").alias("ess"), F.max("lag_limited").alias("lag_limited"))


def convergence_table(diag: DataFrame, block: str, rhat_col: str = "rhat", ess_col: str = "ess", expected: Sequence[str] = ()) -> DataFrame:
    """Per block: parameters, median and largest Rhat, share above 1.05, median and smallest ESS; absent blocks are listed."""
    base = diag.groupBy(block).agg(
        F.count(F.lit(1)).alias("n"), F.max(rhat_col).alias("rhat_max"),
        F.avg((F.col(rhat_col) > 1.05).cast("double")).alias("frac_bad"), F.min(ess_col).alias("ess_min"),
    )
    out = base.join(group_quantiles(diag, [block], rhat_col, {"rhat_med": 0.5}), block, "left")
    out = out.join(group_quantiles(diag, [block], ess_col, {"ess_med": 0.5}), block, "left").withColumn("missing", F.lit(False))
    if expected:
        names = diag.sparkSession.range(1).select(F.explode(F.array(*[F.lit(e) for e in expected])).alias(block))
        absent = names.join(out, block, "left_anti").withColumn("missing", F.lit(True)).withColumn("n", F.lit(0).cast("long"))
        out = out.unionByName(absent, allowMissingColumns=True)
    return out


# ---- contrasts and re-centring ---------------------------------------------------------------------------------


def contrasts(
    draws: DataFrame, keys: Sequence[str], draw: Sequence[str], cls: str, value: str, classes: Sequence[str], bounded: bool = False
) -> DataFrame:
    """Median and 95 % interval of to − from for every ordered class pair.

    Only pairs in list order are summarised from the draws; the reverse contrast is the mirror image of the result
    (median and interval change sign), which halves the work.
    """
    diffs = class_pairs(draws, [*keys, *draw], cls, value, classes, ordered=False)
    half = group_quantiles(diffs, [*keys, "from_class", "to_class"], "diff", CI, bounded)
    mirror = half.select(
        *keys, F.col("to_class").alias("from_class"), F.col("from_class").alias("to_class"),
        (-F.col("q975")).alias("q025"), (-F.col("median")).alias("median"), (-F.col("q025")).alias("q975"),
    )
    return half.unionByName(mirror)


def contrast_table(
    total: DataFrame, pooled: DataFrame, groups: DataFrame, cov: str, group: str, scales: DataFrame | None = None, zero: Sequence[str] = ()
) -> DataFrame:
    """Contrasts for every group: fitted ones, and the pooled contrast (flagged) for groups absent from the fit.

    Inert covariates are set to exactly 0; the display scale is attached (1 when unknown).
    """
    fitted = total.withColumn("pooled", F.lit(False))
    absent = groups.select(group).distinct().join(total.select(group).distinct(), group, "left_anti")
    extra = pooled.withColumn("_one", F.lit(1)).join(absent.withColumn("_one", F.lit(1)), "_one").drop("_one").withColumn("pooled", F.lit(True))
    out = fitted.unionByName(extra)
    if zero:
        out = out.withColumns({c: F.when(F.col(cov).isin(*zero), 0.0).otherwise(F.col(c)) for c in ("q025", "median", "q975")})
    if scales is not None:
        out = out.join(scales, cov, "left").withColumn("sd_x", F.coalesce("sd_x", F.lit(1.0)))
    return out


def to_zero_sum(draws: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Subtract the class mean within every (covariate, group, draw) key; a key holds one row per class."""
    return draws.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))


def expand_baseline(draws: DataFrame, keys: Sequence[str], cls: str, value: str, baseline: str) -> DataFrame:
    """Add the baseline class with coefficient 0, then re-centre to zero sum."""
    base = draws.select(*keys).distinct().withColumn(cls, F.lit(baseline)).withColumn(value, F.lit(0.0))
    return to_zero_sum(draws.select(*keys, cls, value).unionByName(base), keys, value)


def restore_reference(draws: DataFrame, keys: Sequence[str], cov: str, value: str, kept: Sequence[str], reference: str) -> DataFrame:
    """Append the dropped reference column of a block as minus the sum of the kept ones."""
    ref = draws.where(F.col(cov).isin(*kept)).groupBy(*keys).agg((-F.sum(value)).alias(value)).withColumn(cov, F.lit(reference))
    return draws.select(*keys, cov, value).unionByName(ref)


def integrate_years(draws: DataFrame, keys: Sequence[str], cov: str, value: str, year_covs: Sequence[str], n_years: int) -> DataFrame:
    """Fold year effects into the intercept as their mean over ``n_years`` years and drop their rows."""
    is_year = F.col(cov).isin(*year_covs)
    weight = F.when(is_year, F.lit(1.0 / n_years)).otherwise(F.lit(1.0))
    name = F.when(is_year, F.lit("intercept")).otherwise(F.col(cov))
    return draws.select(*keys, name.alias(cov), (F.col(value) * weight).alias(value)).groupBy(*keys, cov).agg(F.sum(value).alias(value))


# ---- decomposition and effects ---------------------------------------------------------------------------------


def decompose(
    pooled: DataFrame, total: DataFrame, means: DataFrame, draw: Sequence[str], cov: str, cls: str, group: str,
    re_col: str, gamma: dict[str, str], value: str = "value",
) -> DataFrame:
    """Group coefficient = pooled slope μ + contextual Σ γ·x̄ + residual u, summarised over draws.

    ``pooled`` is (cov, class, draw, value), ``total`` adds the group; ``gamma`` names the pooled covariate that carries each
    column of ``means`` (one scaled row per group).  Intervals are taken over draws of the sum.
    """
    mu = pooled.where(F.col(cov) == re_col).select(cls, *draw, F.col(value).alias("mu"))
    bg = total.where(F.col(cov) == re_col).select(cls, group, *draw, F.col(value).alias("bg"))
    long = means.select(group, F.explode(F.array(*[
        F.struct(F.lit(g).alias(cov), F.col(c).alias("_xb")) for c, g in gamma.items()
    ])).alias("r")).select(group, "r.*")
    # one row per (class, group, draw): γ pivoted to a row first, so the group join does not multiply by columns
    g_wide = pooled.where(F.col(cov).isin(*gamma.values())).groupBy(cls, *draw).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(cov), F.col(value)))).alias("_g")
    )
    x_map = long.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct(F.col(cov), F.col("_xb")))).alias("_x"))
    terms = F.transform(F.map_keys("_x"), lambda k: F.coalesce(F.try_element_at(F.col("_g"), k), F.lit(0.0)) * F.col("_x")[k])
    ctx = F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)
    j = bg.join(mu, [cls, *draw]).join(g_wide, [cls, *draw], "left").join(x_map, group)
    parts = j.select(
        group, cls, *draw, "mu", (F.col("bg") - F.col("mu")).alias("u"), F.coalesce(ctx, F.lit(0.0)).alias("contextual"),
    ).withColumn("total", F.col("mu") + F.col("u") + F.col("contextual"))
    base = parts.groupBy(group, cls).agg(*[F.avg(c).alias(c) for c in ("mu", "contextual", "u", "total")])
    q = group_quantiles(parts, [group, cls], "total", {"total_lo": 0.025, "total_hi": 0.975})
    a, b = F.abs("contextual"), F.abs("u")
    share = F.when(F.abs(F.col("contextual") + F.col("u")) > 1e-12, a / (a + b))
    return base.join(q, [group, cls]).withColumn("share_contextual", share)


def variance_explained(dec: DataFrame, cls: str) -> DataFrame:
    """Between-group variance of the total, contextual and residual parts, and the share the context explains."""
    out = dec.groupBy(cls).agg(
        F.var_samp("total").alias("var_total"), F.var_samp("contextual").alias("var_contextual"), F.var_samp("u").alias("var_resid")
    )
    return out.withColumn("explained", F.when(F.col("var_total") > 0, 1 - F.col("var_resid") / F.col("var_total")))


def population_effect(
    total: DataFrame, pooled: DataFrame, weights: DataFrame, cov: str, group: str, draw: Sequence[str], value: str = "value"
) -> DataFrame:
    """Size-weighted average of the group effects per draw, summarised: mean, sd, interval, share of groups above 0."""
    w = with_group_values(weights, [], _t=F.sum("weight")).select(group, (F.col("weight") / F.col("_t")).alias("_w"))
    theta = total.join(w, group).groupBy(cov, *draw).agg(F.sum(F.col(value) * F.col("_w")).alias("_th"))
    base = theta.groupBy(cov).agg(F.avg("_th").alias("theta_w"), F.stddev_samp("_th").alias("sd"))
    q = group_quantiles(theta, [cov], "_th", {"q_lo": 0.025, "q_hi": 0.975})
    mu = pooled.groupBy(cov).agg(F.avg(value).alias("mu"))
    pos = total.groupBy(cov, group).agg(F.avg(value).alias("_m")).groupBy(cov).agg(F.avg((F.col("_m") > 0).cast("double")).alias("frac_pos"))
    return mu.join(base, cov).join(q, cov).join(pos, cov)


def group_deviation(total: DataFrame, pooled: DataFrame, cov: str, cls: str, group: str, value: str = "value", intercept: str = "intercept") -> DataFrame:
    """Deviation of each group from the pooled means: RMS, RMS of the intercept, and the intercept's share of squares."""
    b = total.groupBy(group, cov, cls).agg(F.avg(value).alias("_b"))
    m = pooled.groupBy(cov, cls).agg(F.avg(value).alias("_m"))
    dev = b.join(m, [cov, cls]).withColumn("_d2", (F.col("_b") - F.col("_m")) * (F.col("_b") - F.col("_m")))
    is_int = F.col(cov) == intercept
    return dev.groupBy(group).agg(
        F.sqrt(F.avg("_d2")).alias("re_rms"), F.sqrt(F.avg(F.when(is_int, F.col("_d2")))).alias("intercept_rms"),
        (F.coalesce(F.sum(F.when(is_int, F.col("_d2"))), F.lit(0.0)) / F.greatest(F.sum("_d2"), F.lit(1e-12))).alias("intercept_share"),
    )


def deviation_by_cov(total: DataFrame, pooled: DataFrame, cov: str, cls: str, group: str, top: int, value: str = "value") -> DataFrame:
    """RMS deviation per (group, covariate) for the covariates that vary most between groups (top-k report)."""
    b = total.groupBy(group, cov, cls).agg(F.avg(value).alias("_b"))
    m = pooled.groupBy(cov, cls).agg(F.avg(value).alias("_m"))
    dev = b.join(m, [cov, cls]).groupBy(group, cov).agg(F.sqrt(F.avg((F.col("_b") - F.col("_m")) * (F.col("_b") - F.col("_m")))).alias("rms"))
    best = dev.groupBy(cov).agg(F.avg("rms").alias("_r")).orderBy(F.desc("_r"), F.asc(cov)).limit(top).select(cov)
    return dev.join(best, cov, "left_semi")


def lambda_summary(draws: DataFrame, by: Sequence[str], n_children: Column, value: str = "value") -> DataFrame:
    """Scale parameter of a nest: zero-sum inclusive-value coefficient × K/(K−1); median, interval, in (0, 1]."""
    scaled = draws.withColumn("_l", F.col(value) * n_children / (n_children - 1))
    q = group_quantiles(scaled, by, "_l", {"lambda_q025": 0.025, "lambda": 0.5, "lambda_q975": 0.975})
    return q.withColumn("in_unit_interval", (F.col("lambda") > 0) & (F.col("lambda") <= 1))


def iv_r2(df: DataFrame, cols: Sequence[str], ivs: Sequence[str]) -> DataFrame:
    """R² of each inclusive value on the design (intercept included), from one pass of second moments."""
    names = [*cols, *ivs]
    pos = {c: i for i, c in enumerate(names)}
    s = np.zeros((len(names), len(names)))
    for r in pair_moments(df, names).collect():
        s[pos[r["a"]], pos[r["b"]]] = s[pos[r["b"]], pos[r["a"]]] = r["cov"] or 0.0
    k = len(cols)
    rows = []
    for iv in ivs:
        v = s[pos[iv], pos[iv]]
        fit = s[:k, pos[iv]] @ np.linalg.pinv(s[:k, :k]) @ s[:k, pos[iv]]
        rows.append((iv, float(max(0.0, fit / v)) if v > 0 else None))
    return df.sparkSession.createDataFrame(rows, "iv string, r2 double")


def field_moments(df: DataFrame, cols: Sequence[str], rank: int, skew_tol: float = 1.0, kurt_tol: float = 2.0):
    """Mean field, sigma-point fields and a normality test of M imputed fields (wide columns ``cols``).

    The M × M Gram matrix comes from second moments about the row mean; directions are applied as row expressions.
    Returns (fields, weights, test): fields adds ``field_0`` (mean) and ``field_<q>p/m``; with M = 1 only the mean.
    """
    m = len(cols)
    mean = sum((F.col(c) for c in cols), F.lit(0.0)) / m
    base = df.withColumn("field_0", mean)
    if m < 2:
        return base, {"field_0": 1.0}, {"gaussian": True, "max_skew": 0.0, "max_kurt": 0.0}
    rank = max(1, min(rank, m - 1))
    centred = base.select(*[(F.col(c) - F.col("field_0")).alias(c) for c in cols])
    sums = centred.agg(*[
        F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j
    ]).first()
    gram = np.array([[sums[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(m)] for i in range(m)])
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    weights = {"field_0": 1 - rank / 3}
    skews, kurts, added = [], [], {}
    for q in range(rank):
        v = vectors[:, q]
        direction = sum(((F.col(c) - F.col("field_0")) * float(v[i]) for i, c in enumerate(cols)), F.lit(0.0)) / math.sqrt(m - 1)
        added[f"field_{q + 1}p"] = F.col("field_0") + math.sqrt(3.0) * direction
        added[f"field_{q + 1}m"] = F.col("field_0") - math.sqrt(3.0) * direction
        weights[f"field_{q + 1}p"] = weights[f"field_{q + 1}m"] = 1 / 6
        s = math.sqrt(max(values[q], 0.0)) * v
        s = s - s.mean()
        var = float((s**2).mean())
        if var >= 1e-12:
            skews.append(float((s**3).mean()) / var**1.5)
            kurts.append(float((s**4).mean()) / var**2 - 3)
    total = sum(weights.values())
    test = {"max_skew": max(map(abs, skews), default=0.0), "max_kurt": max(map(abs, kurts), default=0.0)}
    test["gaussian"] = test["max_skew"] <= skew_tol and test["max_kurt"] <= kurt_tol
    return base.withColumns(added), {k: w / total for k, w in weights.items()}, test


# Magnitudes at which surviving coefficients are counted.
THRESHOLDS = (1.0, 0.5, 0.1, 0.05, 0.01, 0.001)


def shrinkage_summary(coefs: DataFrame, value: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """How many coefficients (on the display scale) exceed each magnitude, one aggregate for all thresholds."""
    n = F.count(value)
    rows = F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.count(F.when(F.abs(F.col(value)) > t, 1)).alias("n_above"), n.alias("n")) for t in thresholds
    ])
    out = coefs.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return out.withColumn("pct", F.round(100 * F.col("n_above") / F.col("n"), 1))


def effective_parameters(kappa: DataFrame, by: Sequence[str], value: str = "kappa") -> DataFrame:
    """Σ (1 − κ), and how many parameters are active (κ < ½) or shrunk."""
    return kappa.groupBy(*by).agg(
        F.sum(1 - F.col(value)).alias("p_eff"), F.count(F.when(F.col(value) < 0.5, 1)).alias("n_active"),
        F.count(F.when(F.col(value) >= 0.5, 1)).alias("n_shrunk"),
    )


def predicted_totals(totals: DataFrame, by: Sequence[str], value: str = "total") -> DataFrame:
    """Median and 95 % interval over draws of class totals, from one row per (by, draw)."""
    return group_quantiles(totals, by, value, {"est_q025": 0.025, "est_median": 0.5, "est_q975": 0.975})
