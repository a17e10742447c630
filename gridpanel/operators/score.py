"""Scoring: utilities, softmax, predictive averages, counts, nested probabilities, projection and effects.

A design row carries its covariates as one array ``x`` in the recipe's column order; coefficients come as one row per
group (and draw) with a matrix ``b[class][covariate]``.  Coefficients are model-sized: they are shipped to the tasks in
chunks of limited size, and Arrow batches of rows are multiplied with them.  Scoring is a narrow map: no row is shuffled
and no row is copied per draw.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.functions.scalar import normal_icdf
from gridpanel.operators import drawstore as ds
from gridpanel.operators.focal import focal_columns
from gridpanel.plans.skew import HASH_BITS, hash_order
from gridpanel.session import cut_lineage

POOLED = ds.POOLED


# ---- row expressions -------------------------------------------------------------------------------------------


def dot(x: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(x, b, lambda a, c: a * c), F.lit(0.0), lambda s, v: s + v)


def utilities(x: Column, b: Column) -> Column:
    """Array of class utilities from the covariate array and the class × covariate matrix."""
    return F.transform(b, lambda row: dot(x, row))


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression; a lambda body would evaluate it at every mention."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def softmax(u: Column) -> Column:
    """Softmax of an array with the maximum subtracted."""
    def scale(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda s, w: s + w), lambda t: F.transform(e, lambda v: v / t))

    return let(u, lambda w: let(F.array_max(w), lambda m: let(F.transform(w, lambda v: F.exp(v - m)), scale)))


def softmax_long(df: DataFrame, keys: Sequence[str], u: str, out: str = "p") -> DataFrame:
    """Softmax over long rows; a key holds one row per class."""
    w = Window.partitionBy(*keys)
    e = F.exp(F.col(u) - F.max(u).over(w))
    return df.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def expand_classes(u: Column, class_map: Sequence[int]) -> Column:
    """Fitted utilities → output classes; siblings share −log(count), so they add up to their parent."""
    counts = {m: class_map.count(m) for m in class_map}
    pairs = F.array(*[F.struct(F.lit(m).alias("m"), F.log(F.lit(float(counts[m]))).alias("k")) for m in class_map])
    return F.transform(pairs, lambda p: F.get(u, p["m"]) - p["k"])


def feature_array(df: DataFrame, cols: Sequence[str], out: str = "x") -> DataFrame:
    return df.withColumn(out, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]))


def explode_classes(df: DataFrame, keys: Sequence[str], arr: str, classes: Sequence[str], out: str = "p") -> DataFrame:
    """Array of class values → long rows."""
    names = F.array(*[F.lit(c) for c in classes])
    return df.select(*keys, F.posexplode(arr).alias("_i", out)).select(*keys, F.get(names, F.col("_i")).alias("class"), out)


# ---- coefficient tables ----------------------------------------------------------------------------------------


def coefficient_matrix(
    draws: DataFrame, by: Sequence[str], cov: str, cls: str, value: str, covs: Sequence[str], classes: Sequence[str]
) -> DataFrame:
    """Mean coefficients per ``by`` key as one matrix ``b[class][cov]``; missing entries are 0."""
    cells = draws.groupBy(*by, cov, cls).agg(F.avg(value).alias("_v"))
    pick = [
        F.array(*[
            F.coalesce(F.max(F.when((F.col(cls) == c) & (F.col(cov) == k), F.col("_v"))), F.lit(0.0)) for k in covs
        ])
        for c in classes
    ]
    return cells.groupBy(*by).agg(F.array(*pick).alias("b"))


CHUNK_BYTES = 128 * 2**20  # largest coefficient block shipped to the tasks at once


def _matrix(b) -> np.ndarray:
    return np.asarray([list(r) for r in b], dtype=float)


def load_coefficients(coef: DataFrame, group: str) -> dict[str, np.ndarray]:
    """A plug-in table as {group: array[1, class, cov]}; callers have checked its size. Draws go through ``drawstore``."""
    return {r[group]: _matrix(r["b"])[None] for r in coef.select(group, "b").collect()}


def _by_group(groups: pd.Series, block: dict) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Row positions and coefficients per group of a batch; unknown groups share the pooled coefficients."""
    label = groups.where(groups.isin(list(block)), POOLED).to_numpy()
    for g in pd.unique(label):
        if g not in block:
            raise ValueError("a group was not fitted and there are no pooled coefficients")
        yield np.flatnonzero(label == g), block[g], g == POOLED


def predict_shares(
    df: DataFrame, coef: DataFrame, group: str, x: str = "x", class_map: Sequence[int] | None = None,
    offset: str | None = None, out: str = "p",
) -> DataFrame:
    """Plug-in prediction: softmax of X·β_group, plus an array of extra utilities (trees, alternative terms).

    Adds the utilities ``u``, whether the pooled coefficients served the row (its group was not fitted), and the shares.
    A coefficient table above ``CHUNK_BYTES`` is joined on the group instead of being shipped whole.
    """
    size = coef.agg(F.sum(F.size("b") * F.size(F.get("b", F.lit(0))) * 8).alias("n")).first()["n"] or 0
    if size > CHUNK_BYTES:
        return _predict_joined(df, coef, group, x, class_map, offset, out)
    block = df.sparkSession.sparkContext.broadcast(load_coefficients(coef, group))

    @F.pandas_udf("u array<double>, pooled boolean, p array<double>")
    def score(xs: pd.Series, groups: pd.Series, extra: pd.Series) -> pd.DataFrame:
        design = np.vstack(xs.to_numpy())
        u, pooled, p = [None] * len(xs), np.zeros(len(xs), dtype=bool), [None] * len(xs)
        for at, b, is_pooled in _by_group(groups, block.value):
            ug = design[at] @ b[0].T
            if offset:
                ug = ug + np.vstack(extra.to_numpy()[at])
            pg = ds.np_softmax(ds.expand(ug, class_map))
            pooled[at] = is_pooled
            for i, row in enumerate(at):
                u[row], p[row] = ug[i], pg[i]
        return pd.DataFrame({"u": u, "pooled": pooled, "p": p})

    scored = df.withColumn("_s", score(F.col(x), F.col(group), F.col(offset) if offset else F.lit(None).cast("array<double>")))
    return scored.withColumns({"u": F.col("_s.u"), "pooled": F.col("_s.pooled"), out: F.col("_s.p")}).drop("_s")


def _predict_joined(
    df: DataFrame, coef: DataFrame, group: str, x: str, class_map: Sequence[int] | None, offset: str | None, out: str
) -> DataFrame:
    """Plug-in prediction by an equi join on the group and row expressions; only the pooled matrix is one row."""
    pooled = coef.where(F.col(group) == POOLED).select(F.col("b").alias("_bp"), F.lit(1).alias("_one"))
    joined = df.join(coef.where(F.col(group) != POOLED).select(group, "b"), group, "left")
    joined = joined.withColumn("_one", F.lit(1)).join(pooled, "_one", "left").withColumn("pooled", F.col("b").isNull())
    missing = F.raise_error(F.lit("a group was not fitted and there are no pooled coefficients"))
    u = utilities(F.col(x), F.coalesce(F.col("b"), F.col("_bp"), missing))
    if offset:
        u = F.zip_with(u, F.col(offset), lambda a, c: a + c)
    joined = joined.withColumn("u", u)
    final = F.col("u") if class_map is None else expand_classes(F.col("u"), class_map)
    return joined.withColumn(out, softmax(final)).select(*df.columns, "u", "pooled", out)


def predict_predictive(
    df: DataFrame, draws: DataFrame, key: Sequence[str], group: str, draw: str, n_classes: int, x: str = "x",
    out: str = "p", class_map: Sequence[int] | None = None, chunk_bytes: int = ds.CHUNK_BYTES,
) -> DataFrame:
    """Posterior-predictive shares: softmax averaged over draws (group, draw, b); unseen groups use the pooled draws."""
    return ds.predictive_shares(df, ds.matrix_parts(draws, group, draw), key, group, n_classes, x, class_map, out=out, chunk_bytes=chunk_bytes)


def marginal_draws(group_coef: DataFrame, pooled: DataFrame, cov: str, cls: str, value: str, draws: int, seed: int) -> DataFrame:
    """Coefficient draws for an unseen group: pooled value + N(0, between-group sd of the fitted coefficients).

    ``group_coef``: (group, cov, class, value); ``pooled``: (cov, class, value).  The normal draw is the inverse
    distribution function of a hash of (draw, cov, class), so results do not depend on task order.
    """
    sd = group_coef.groupBy(cov, cls).agg(F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_sd"))
    base = pooled.select(cov, cls, F.col(value).alias("_mu")).join(sd, [cov, cls])
    base = base.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = (hash_order(seed, "draw", cov, cls) + F.lit(0.5)) / F.lit(float(2**HASH_BITS))
    return base.select("draw", cov, cls, (F.col("_mu") + F.col("_sd") * normal_icdf(u)).alias(value))


# ---- counts ----------------------------------------------------------------------------------------------------


def predict_count(
    eta: Column, offset: Column, dispersion: Column | None = None, cap: Column | None = None, density: bool = False
) -> Column:
    """Mean count exp(η + offset) (× the legacy dispersion factor), its density capped before the offset is put back."""
    mu = F.exp(eta + offset)
    if dispersion is not None:
        mu = dispersion * mu
    rate = mu / F.exp(offset)
    if cap is not None:
        rate = F.least(rate, cap)
    return rate if density else rate * F.exp(offset)


# ---- alternative-specific terms and state ---------------------------------------------------------------------


def alt_utility(z: DataFrame, delta: DataFrame, keys: Sequence[str], baseline: str | None = None) -> DataFrame:
    """Utility of alternative-specific blocks: Σ δ·z per alternative.

    ``z`` is (keys, block, alternative, z).  ``delta`` has (block, delta) for shared coefficients or (block, alternative,
    delta) for one per alternative, where the baseline alternative gets 0.
    """
    on = ["block", "alternative"] if "alternative" in delta.columns else ["block"]
    joined = z.join(delta, on, "left").fillna(0.0, ["delta"])
    d = F.col("delta") if baseline is None else F.when(F.col("alternative") == baseline, 0.0).otherwise(F.col("delta"))
    return joined.groupBy(*keys, "alternative").agg(F.sum(d * F.col("z")).alias("u_alt"))


def with_state(df: DataFrame, keys: Sequence[str], classes: Sequence[str], builder: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Attach a previous state from a user function as ``prev_<class>`` shares (0 where the state has no row).

    The function gets the raw rows and returns (keys, one area or share column per class); rows are normalised here.
    """
    past = builder(df)
    missing = [c for c in [*keys, *classes] if c not in past.columns]
    if missing:
        raise ValueError(f"state builder returned no {missing}")
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in classes), F.lit(0.0))
    shares = [F.coalesce(F.try_divide(F.coalesce(F.col(c), F.lit(0.0)), total), F.lit(0.0)).alias(f"prev_{c}") for c in classes]
    return df.join(past.select(*keys, *shares), list(keys), "left").fillna(0.0, [f"prev_{c}" for c in classes])


# ---- projection ------------------------------------------------------------------------------------------------


def project_step(
    state: DataFrame, keys: Sequence[str], by: Sequence[str], ix: str, iy: str, classes: Sequence[str], features: Sequence[str],
    coef: DataFrame, group: str, damp: float = 0.5,
) -> DataFrame:
    """One projection step on a wide state table (keys, features, one share column per class).

    Focal shares of the current state → design → shares → damped blend.  Adds ``delta``, the row's largest change.
    """
    wide = focal_columns(state, by, ix, iy, classes)
    design = feature_array(wide.withColumn("intercept", F.lit(1.0)), ["intercept", *features, *[f"focal_{c}" for c in classes]])
    scored = predict_shares(design, coef, group)
    blend = {c: F.col(c) * (1 - damp) + F.col("p")[j] * damp for j, c in enumerate(classes)}
    change = F.greatest(*[F.abs(b - F.col(c)) for c, b in blend.items()])
    return scored.select(*keys, *[F.col(f) for f in features], *[b.alias(c) for c, b in blend.items()], change.alias("delta"))


def trajectory_row(state: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Largest change and largest class share of a projected state."""
    means = [F.avg(c).alias(c) for c in classes]
    out = state.agg(F.max("delta").alias("max_change"), *means)
    return out.select("max_change", F.greatest(*[F.col(c) for c in classes]).alias("max_class_share"))


def project(state: DataFrame, steps: int, tol: float, step: Callable[[DataFrame], DataFrame], classes: Sequence[str]):
    """Repeat a step until the largest change is below ``tol``; the state is checkpointed after each step."""
    rows = []
    for s in range(1, steps + 1):
        state = cut_lineage(step(state.drop("delta")))
        r = trajectory_row(state, classes).first()
        rows.append((s, float(r["max_change"]), float(r["max_class_share"])))
        if r["max_change"] < tol:
            break
    schema = "step int, max_change double, max_class_share double"
    return state, state.sparkSession.createDataFrame(rows, schema)


# ---- effects ---------------------------------------------------------------------------------------------------


def marginal_effects(p: DataFrame, coef: DataFrame, group: str, cls: str, cov: str) -> DataFrame:
    """Average marginal effects on log P, centred over classes.

    The row average of β_j − Σ_k P_k β_k is linear in P, so it needs only the mean share per (group, class): ``p`` is
    (group, class, p) long with one row per (row, class); ``coef`` is (group, cov, class, beta).
    """
    mean_p = p.groupBy(group, cls).agg(F.avg("p").alias("_mp"), F.count(F.lit(1)).alias("_n"))
    j = coef.join(mean_p, [group, cls])
    w = Window.partitionBy(group, cov)
    ame = j.withColumn("_a", F.col("beta") - F.sum(F.col("beta") * F.col("_mp")).over(w))
    tot = ame.groupBy(cov, cls).agg((F.sum(F.col("_a") * F.col("_n")) / F.sum("_n")).alias("ame"))
    return tot.withColumn("ame", F.col("ame") - F.avg("ame").over(Window.partitionBy(cov)))


def hybrid_offset(f: Column, classes: int, symmetric: bool = True, cap: float | None = None) -> Column:
    """Tree contribution to utilities: capped, then centred over classes (symmetric) or with a zero baseline appended."""
    g = f if cap is None else F.transform(f, lambda v: F.greatest(F.least(v, F.lit(cap)), F.lit(-cap)))
    if symmetric:
        mean = F.aggregate(g, F.lit(0.0), lambda s, v: s + v) / F.lit(float(classes))
        return F.transform(g, lambda v: v - mean)
    return F.concat(g, F.array(F.lit(0.0)))
