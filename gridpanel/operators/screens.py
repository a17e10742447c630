"""Statistical screens on design tables.  Sums over rows run on Spark; only k × k matrices reach the driver."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.plans.skew import group_quantiles, value_counts, with_group_values
from gridpanel.session import cut_lineage


# ---- second moments --------------------------------------------------------------------------------------------


def pair_moments(df: DataFrame, cols: Sequence[str], by: str | None = None) -> DataFrame:
    """Count, means, variances, covariance and correlation of every column pair i ≤ j, overall or per group.

    Each Arrow batch is reduced to its k × k cross products about a common centre (the column means), which are then
    summed: one pass, and a shuffle of matrices instead of rows.  Rows with a NULL in any column are left out.
    """
    cols = list(cols)
    used = df.dropna(subset=cols)
    mean_row = used.agg(*[F.avg(c).alias(c) for c in cols]).first()
    centre = np.array([mean_row[c] if mean_row[c] is not None else 0.0 for c in cols], dtype=float)
    k = len(cols)
    iu = np.triu_indices(k)

    def reduce_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            groups = [(None, batch)] if by is None else batch.groupby("_g", dropna=False)
            for g, part in groups:
                x = part[cols].to_numpy(dtype=float) - centre
                gram, sums = x.T @ x, x.sum(axis=0)
                yield pd.DataFrame({
                    "_g": [g] * len(iu[0]), "i": iu[0], "j": iu[1], "n": len(x), "si": sums[iu[0]], "sj": sums[iu[1]],
                    "sii": np.diag(gram)[iu[0]], "sjj": np.diag(gram)[iu[1]], "sij": gram[iu],
                })

    src = used.select(*([F.col(by).cast("string").alias("_g")] if by else []), *[F.col(c).cast("double").alias(c) for c in cols])
    schema = "_g string, i int, j int, n long, si double, sj double, sii double, sjj double, sij double"
    parts = src.mapInPandas(reduce_batches, schema)
    keys = ["_g", "i", "j"] if by else ["i", "j"]
    s = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sii", "sjj", "sij")])
    names = F.array(*[F.lit(c) for c in cols])
    n = F.col("n")
    cov = F.try_divide(F.col("sij") - F.col("si") * F.col("sj") / n, n - 1)

    def variance(square: str, total: str) -> Column:
        # a column that is constant inside a group leaves only rounding noise of its squares: that counts as 0
        v = F.col(square) - F.col(total) * F.col(total) / n
        return F.try_divide(F.when(v > F.lit(1e-13) * F.col(square), v).otherwise(F.lit(0.0)), n - 1)

    vi, vj = variance("sii", "si"), variance("sjj", "sj")
    out = s.select(
        *([F.col("_g").alias(by)] if by else []), F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"),
        "n", vi.alias("var_a"), vj.alias("var_b"), cov.alias("cov"),
    )
    denom = F.sqrt(F.greatest(F.col("var_a"), F.lit(0.0)) * F.greatest(F.col("var_b"), F.lit(0.0)))
    return out.withColumn("corr", F.try_divide(F.col("cov"), denom))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """k × k correlation matrix on the driver; undefined entries are 0, the diagonal 1."""
    pos = {c: i for i, c in enumerate(cols)}
    out = np.eye(len(cols))
    for r in pair_moments(df, cols).collect():
        if r["a"] != r["b"] and r["corr"] is not None:
            out[pos[r["a"]], pos[r["b"]]] = out[pos[r["b"]], pos[r["a"]]] = r["corr"]
    return out


# ---- constant-sum blocks ---------------------------------------------------------------------------------------


def block_prefix(name: str) -> str:
    """``focal`` for focal columns, the stem of ``stem_s<digit>`` columns, else the name itself."""
    if name.startswith("focal_"):
        return "focal"
    m = re.match(r"^([A-Za-z_]+)(?=_s?\d)", name)
    return m.group(1) if m else name


def constant_sum_blocks(
    df: DataFrame, cols: Sequence[str], tol: float = 1e-4, mean_tol: float = 0.05, cv_tol: float = 0.05,
    dev_tol: float = 0.01, max_dev_frac: float = 0.02,
) -> DataFrame:
    """Blocks of columns whose row sums are constant near 1: median centre, MAD spread, share of rows off the constant."""
    blocks: dict[str, list[str]] = {}
    for c in cols:
        blocks.setdefault(block_prefix(c), []).append(c)
    blocks = {b: cs for b, cs in blocks.items() if len(cs) > 1}
    sums = F.array(*[
        F.struct(F.lit(b).alias("block"), F.lit(len(cs)).alias("n_cols"), sum((F.col(c) for c in cs), F.lit(0.0)).alias("rs"))
        for b, cs in blocks.items()
    ])
    long = df.select(F.explode(sums).alias("r")).select("r.*")
    valid = long.where(F.col("rs") > tol)
    centre = group_quantiles(valid, ["block"], "rs", {"centre": 0.5})
    dev = valid.join(centre, "block").withColumn("d", F.abs(F.col("rs") - F.col("centre")))
    spread = group_quantiles(dev, ["block"], "d", {"_mad": 0.5})
    off = long.join(centre, "block").groupBy("block", "n_cols").agg(
        F.avg((F.abs(F.col("rs") - F.col("centre")) > dev_tol).cast("double")).alias("off_fraction")
    )
    out = centre.join(spread, "block").join(off, "block")
    cv = F.lit(1.4826) * F.col("_mad") / F.greatest(F.abs(F.col("centre")), F.lit(1e-8))
    out = out.withColumn("cv", cv)
    ok = (F.abs(F.col("centre") - 1) < mean_tol) & (F.col("cv") < cv_tol) & (F.col("off_fraction") <= max_dev_frac)
    return out.select("block", "n_cols", "centre", "cv", "off_fraction", ok.alias("accepted"))


# ---- support ---------------------------------------------------------------------------------------------------


def participation_ratio(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), strength: float = 1.0) -> DataFrame:
    """Effective number of observations (Σd²)² / Σd⁴ about the (group) mean, and the support factor (n / PR)^strength.

    Columns constant over the whole table (the intercept) keep factor 1.
    """
    names = {c: f"_m_{c}" for c in cols}
    src = with_group_values(df, by, **{m: F.avg(c) for c, m in names.items()})
    src = with_group_values(src, [], **{f"_sd_{c}": F.stddev_samp(c) for c in cols})

    def d2(c: str) -> Column:
        d = F.col(c) - F.col(names[c])
        return d * d

    aggs = [
        F.struct(
            F.lit(c).alias("cov"), F.count(c).alias("n"), F.sum(d2(c)).alias("s2"), F.sum(d2(c) * d2(c)).alias("s4"),
            F.max(f"_sd_{c}").alias("sd_all"),
        ).alias(f"_r_{c}")
        for c in cols
    ]
    out = src.groupBy(*by).agg(*aggs).select(*by, F.explode(F.array(*[F.col(f"_r_{c}") for c in cols])).alias("r"))
    out = out.select(*by, "r.*")
    pr = F.col("s2") * F.col("s2") / F.greatest(F.col("s4"), F.lit(1e-12))
    out = out.withColumn("pr", pr)
    constant = F.col("sd_all").isNull() | (F.col("sd_all") < 1e-8)
    factor = F.when(constant, F.lit(1.0)).otherwise(F.pow(F.col("n") / F.greatest(F.col("pr"), F.lit(1.0)), F.lit(strength)))
    sd = F.sqrt(F.try_divide(F.col("s2"), F.col("n") - 1))
    return out.select(*by, "cov", "n", sd.alias("sd"), "pr", factor.alias("factor"))


def support_screen(df: DataFrame, cols: Sequence[str], min_frac: float = 0.005, cor_limit: float = 0.999) -> DataFrame:
    """Columns to drop: near-constant, low support, or near-duplicates (the one with lower support goes)."""
    stats = {r["cov"]: r for r in participation_ratio(df, cols).collect()}
    dropped: dict[str, str] = {}
    for c in cols:
        floor = max(20.0, min_frac * stats[c]["n"])
        if stats[c]["sd"] is None or stats[c]["sd"] < 1e-8:
            dropped[c] = "constant"
        elif stats[c]["pr"] < floor:
            dropped[c] = "low_support"
    alive = [c for c in cols if c not in dropped]
    if len(alive) > 1:
        corr = np.abs(correlation_matrix(df, alive))
        for i, j in zip(*np.where(np.triu(corr, 1) > cor_limit)):
            a, b = alive[i], alive[j]
            if a not in dropped and b not in dropped:
                dropped[a if stats[a]["pr"] <= stats[b]["pr"] else b] = "duplicate"
    rows = [(c, float(stats[c]["pr"]), c not in dropped, dropped.get(c, "")) for c in cols]
    return df.sparkSession.createDataFrame(rows, "cov string, pr double, kept boolean, reason string")


# ---- identifiability -------------------------------------------------------------------------------------------


def group_pairs(df: DataFrame, group: str, cols: Sequence[str], limit: float = 0.95, min_obs: int = 10) -> DataFrame:
    """Column pairs of each group with |correlation| above the limit (groups below ``min_obs`` rows are not judged)."""
    pairs = pair_moments(df, cols, group).where(F.col("a") != F.col("b"))
    hit = (F.col("n") >= min_obs) & (F.abs(F.coalesce(F.col("corr"), F.lit(0.0))) > limit)
    return pairs.withColumn("judged", F.col("n") >= min_obs).withColumn("hit", hit)


def identifiability_mask(
    df: DataFrame, group: str, cols: Sequence[str], limit: float = 0.95, min_obs: int = 10, sd_tol: float = 1e-8
) -> DataFrame:
    """(group, covariate) slopes to pin at 0: no variation inside the group, or collinear with a more variable column.

    Pairs are resolved in column order inside each group, on the group's own short pair list.
    """
    order = {c: i for i, c in enumerate(cols)}
    moments = pair_moments(df, cols, group)
    overall = df.agg(*[F.stddev_samp(c).alias(c) for c in cols]).first()
    live = [c for c in cols if overall[c] is not None and overall[c] >= sd_tol]
    diag = moments.where((F.col("a") == F.col("b")) & F.col("a").isin(*live))
    flat = diag.where(F.col("var_a").isNull() | (F.sqrt(F.greatest("var_a", F.lit(0.0))) < sd_tol))
    flat = flat.select(group, F.col("a").alias("cov"), F.lit("no_variation").alias("reason"))
    index = F.create_map(*[F.lit(v) for c in cols for v in (c, order[c])])
    near = moments.where(
        (F.col("a") != F.col("b")) & (F.col("n") >= min_obs) & (F.abs(F.coalesce(F.col("corr"), F.lit(0.0))) > limit)
    ).withColumn("ia", index[F.col("a")]).withColumn("ib", index[F.col("b")])
    # column-major order of the upper triangle: by the later column, then the earlier one
    listed = near.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("ib", "ia", "a", "b", "var_a", "var_b"))).alias("_p"))
    step = F.aggregate(
        F.col("_p"), F.array().cast("array<string>"),
        lambda acc, p: F.when(F.array_contains(acc, p["a"]) | F.array_contains(acc, p["b"]), acc).otherwise(
            F.array_append(acc, F.when(p["var_a"] <= p["var_b"], p["a"]).otherwise(p["b"]))
        ),
    )
    collinear = listed.select(group, F.explode(step).alias("cov"), F.lit("collinear").alias("reason"))
    return flat.unionByName(collinear)


def group_collinearity(
    df: DataFrame, group: str, cols: Sequence[str], limit: float = 0.85, min_share: float = 0.5, global_share: float = 0.75
) -> DataFrame:
    """Pairs that are collinear in many groups: dropped everywhere when widespread, else masked where they occur.

    The column with the smaller overall variance goes.
    """
    pairs = group_pairs(df, group, cols, limit)
    valid = pairs.where(F.col("judged"))
    counts = valid.groupBy("a", "b").agg(
        F.avg(F.col("hit").cast("double")).alias("hit_fraction"),
        F.max(F.abs(F.coalesce(F.col("corr"), F.lit(0.0)))).alias("max_corr"),
        F.array_sort(F.collect_set(F.when(F.col("hit"), F.col(group)))).alias("groups"),
    )
    overall = pair_moments(df, cols).select("a", "b", "var_a", "var_b")
    out = counts.where(F.col("hit_fraction") >= min_share).join(overall, ["a", "b"])
    drop = F.when(F.col("var_a") <= F.col("var_b"), F.col("a")).otherwise(F.col("b"))
    keep = F.when(F.col("var_a") <= F.col("var_b"), F.col("b")).otherwise(F.col("a"))
    scope = F.when(F.col("hit_fraction") >= global_share, "global").otherwise("local")
    return out.select(drop.alias("dropped"), keep.alias("kept"), "hit_fraction", "max_corr", scope.alias("scope"), "groups")


def presence_mask(df: DataFrame, row: str, group: str, cls: str, value: str) -> DataFrame:
    """Effective counts and variance ratios of every class in every group.

    ``df`` holds every (row, class), zeros included.  A cell is masked when the class does not vary in the group, flagged
    absent when it never exceeds 0.1 % of the mean row total, and sparse when its effective count is below the
    size-dependent threshold.
    """
    total = df.agg((F.sum(value) / F.countDistinct(row)).alias("_mean_total")).withColumn("_one", F.lit(1))
    wide = df.groupBy(cls).agg(F.var_samp(value).alias("var_global"))
    src = df.withColumn("_one", F.lit(1)).join(total, "_one")
    cells = src.groupBy(group, cls).agg(
        F.count(F.lit(1)).alias("n"), (F.sum(value) / F.max("_mean_total")).alias("n_effective"),
        F.var_samp(value).alias("var_local"),
        F.count(F.when(F.col(value) > F.col("_mean_total") * 0.001, 1)).alias("n_present"),
    )
    out = cells.join(wide, cls)
    need = F.least(F.lit(5), F.greatest(F.lit(2), F.ceil(F.col("n") * 0.01)))
    small = F.col("var_local").isNull() | (F.col("var_local") < 1e-8) | (F.col("var_global") < 1e-8)
    return out.select(
        group, cls, "n", "n_effective", F.try_divide("var_local", "var_global").alias("var_ratio"),
        small.alias("masked"), (F.col("n_present") == 0).alias("absent"), (F.col("n_effective") < need).alias("sparse"),
    )


def separation_screen(
    x: DataFrame, y: DataFrame, row: str, group: str, cols: Sequence[str], cls: str, value: str, min_obs: int = 10
) -> DataFrame:
    """Covariates whose 5–95 % range where a class is present does not meet the range of the rest.

    ``x`` is wide (row, group, covariates), ``y`` long (row, class, value) with zeros.  A row may be on both sides.
    ``overlap`` is the overlap of the two ranges relative to their union.
    """
    row_total = y.groupBy(row).agg(F.sum(value).alias("_t"))
    level = row_total.agg((F.avg("_t") * 0.01).alias("_thr")).withColumn("_one", F.lit(1))
    flags = y.join(row_total, row).withColumn("_one", F.lit(1)).join(level, "_one")
    sides = F.array_compact(F.array(
        F.when(F.col(value) > F.col("_thr"), F.lit("present")),
        F.when(F.col("_t") - F.col(value) > F.col("_thr"), F.lit("rest")),
    ))
    flags = flags.select(row, cls, F.explode(sides).alias("side"))
    covs = F.explode(F.array(*[F.struct(F.lit(c).alias("cov"), F.col(c).cast("double").alias("x")) for c in cols]))
    long = x.join(flags, row).select(group, cls, "side", covs.alias("c")).select(group, cls, "side", "c.cov", "c.x")
    keys = [group, cls, "cov", "side"]
    # row × class × covariate is the costly table: it is reduced to value counts once, for ranges and variances
    counts = cut_lineage(value_counts(long, keys, "x"))
    ranges = group_quantiles(long, keys, "x", {"lo": 0.05, "hi": 0.95}, counts=counts)
    n, s1 = F.sum("_n"), F.sum(F.col("_n") * F.col("_v"))
    square = F.sum(F.col("_n") * F.col("_v") * F.col("_v"))
    spread = counts.groupBy(*keys).agg(F.try_divide(F.greatest(square - s1 * s1 / n, F.lit(0.0)), n - 1).alias("v"))
    both = ranges.join(spread, keys)

    def side(name: str, c: str) -> Column:
        return F.max(F.when(F.col("side") == name, F.col(c)))

    sizes = x.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    out = both.groupBy(group, cls, "cov").agg(
        side("present", "lo").alias("lo_1"), side("present", "hi").alias("hi_1"), side("present", "v").alias("v_1"),
        side("rest", "lo").alias("lo_b"), side("rest", "hi").alias("hi_b"),
    ).join(sizes, group).where(F.col("n") >= min_obs)
    disjoint = (F.col("lo_1") >= F.col("hi_b")) | (F.col("lo_b") >= F.col("hi_1"))
    low_var = F.coalesce(F.col("v_1"), F.lit(0.0)) < 1e-4
    bounded = ((F.col("hi_b") < 1e-3) & (F.col("hi_1") > 0.05)) | ((F.col("hi_1") < 1e-3) & (F.col("hi_b") > 0.05))
    one_sided = F.col("hi_1").isNull() | F.col("hi_b").isNull()
    meet = F.least("hi_1", "hi_b") - F.greatest("lo_1", "lo_b")
    union = F.greatest("hi_1", "hi_b") - F.least("lo_1", "lo_b") + 1e-9
    overlap = F.when(one_sided, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), meet / union))
    flagged = F.when(one_sided, F.lit(True)).otherwise(disjoint | low_var | bounded)
    return out.select(group, cls, "cov", "lo_1", "hi_1", "lo_b", "hi_b", overlap.alias("overlap"), flagged.alias("flagged"))


# ---- column selection ------------------------------------------------------------------------------------------


def decorrelate(
    df: DataFrame, cols: Sequence[str], thresh: float, prefer: Sequence[str] = (), protect: Sequence[str] = ()
) -> list[str]:
    """Drop one column of the most correlated pair until every |correlation| is below ``thresh``.

    Protected columns stay; a preferred column survives a plain one; else the one with the larger mean correlation goes.
    """
    names = list(cols)
    c = np.abs(correlation_matrix(df, names))
    np.fill_diagonal(c, 0.0)
    alive = np.ones(len(names), dtype=bool)
    while True:
        view = np.where(alive[:, None] & alive[None, :], c, 0.0)
        if not alive.any() or view.max() < thresh or view.max() == 0.0:
            return [n for n, keep in zip(names, alive) if keep]
        j, i = np.argwhere(view.T == view.max())[0]  # first pair in column-major order
        a, b = names[i], names[j]
        if a in protect and b in protect:
            c[i, j] = c[j, i] = 0.0
            continue
        size = alive.sum()
        drop = i if view[i].sum() / size >= view[j].sum() / size else j
        if a in protect:
            drop = j
        elif b in protect:
            drop = i
        elif a in prefer and b not in prefer:
            drop = j
        elif b in prefer and a not in prefer:
            drop = i
        alive[drop] = False


def rank_guard(df: DataFrame, cols: Sequence[str], intercept: str = "intercept", tol: float = 1e-7) -> dict[str, str]:
    """Columns to drop: constant ones, then those that pivoted elimination of the Gram matrix finds dependent.

    The intercept is never dropped; centring the columns accounts for it.
    """
    body = [c for c in cols if c != intercept]
    pos = {c: i for i, c in enumerate(body)}
    cov = np.zeros((len(body), len(body)))
    for r in pair_moments(df, body).collect():
        cov[pos[r["a"]], pos[r["b"]]] = cov[pos[r["b"]], pos[r["a"]]] = r["cov"] or 0.0
    out = {c: "constant" for c in body if cov[pos[c], pos[c]] < 1e-12}
    keep = [c for c in body if c not in out]
    idx = [pos[c] for c in keep]
    g = cov[np.ix_(idx, idx)]
    d = np.sqrt(np.diag(g)) if len(idx) else np.zeros(0)
    g = g / np.outer(d, d) if len(idx) else g
    for k, c in enumerate(keep):  # columns are taken in order, so the later duplicate is the one to go
        if g[k, k] < tol:
            out[c] = "dependent"
            continue
        rest = slice(k + 1, None)
        g[rest, rest] -= np.outer(g[rest, k], g[k, rest]) / g[k, k]
    return out


def inert_columns(df: DataFrame, cols: Sequence[str], tol: float = 1e-12) -> DataFrame:
    """Variance per column and whether it is inert (no variance and not the all-ones intercept)."""
    aggs = [
        F.struct(F.lit(c).alias("cov"), F.var_samp(c).alias("variance"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"_{c}")
        for c in cols
    ]
    out = df.agg(*aggs).select(F.explode(F.array(*[F.col(f"_{c}") for c in cols])).alias("r")).select("r.*")
    ones = (F.col("lo") == 1) & (F.col("hi") == 1)
    flat = F.col("variance").isNull() | (F.col("variance") < tol)
    return out.select("cov", "variance", (flat & ~ones).alias("inert"))
