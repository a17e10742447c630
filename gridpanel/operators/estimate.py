"""Distributed estimators: weighted logits, count regression, partial pooling, nested fits and replicate draws."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from gridpanel.functions.scalar import finite_or
from gridpanel.operators.allocate import to_pseudocounts
from gridpanel.operators.design import Paths, edges, node_shares
from gridpanel.operators.metrics import compare_fits
from gridpanel.operators.score import explode_classes, feature_array, predict_shares, softmax
from gridpanel.plans.skew import HASH_BITS, hash_order, with_group_values
from gridpanel.session import cut_lineage, release, written

COEF_SCHEMA = "cov string, class string, beta double"


# ---- share logits ----------------------------------------------------------------------------------------------


def fit_share_logit(
    x: DataFrame, y: DataFrame, row: str, cols: Sequence[str], classes: Sequence[str], weight: str = "share", cls: str = "class",
    reg: float = 1e-6, max_iter: int = 60,
) -> DataFrame:
    """Fractional multinomial logit: one weighted training row per (row, class) with its share as weight.

    Returns zero-sum coefficients (cov, class, beta) with ``intercept``.  The data stay distributed; only the
    coefficient matrix comes back.
    """
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(cls)) - 1
    used = y.where((F.col(weight) > 0) & F.col(cls).isin(*classes)).select(row, index.cast("double").alias("_y"), F.col(weight).alias("_w"))
    clean = x.select(row, *[finite_or(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    train = VectorAssembler(inputCols=list(cols), outputCol="_x").transform(used.join(clean, row)).select("_x", "_y", "_w")
    # the optimiser passes over the rows many times
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        lr = LogisticRegression(
            featuresCol="_x", labelCol="_y", weightCol="_w", family="multinomial", regParam=reg, elasticNetParam=0.0, maxIter=max_iter, tol=1e-7
        )
        model = lr.fit(train)
        b = model.coefficientMatrix.toArray()
        a = model.interceptVector.toArray()
    finally:
        train.unpersist()
    full = np.zeros((len(classes), len(cols) + 1))
    full[: len(a), 0] = a
    full[: len(a), 1:] = b
    full = full - full.mean(axis=0, keepdims=True)
    names = ["intercept", *cols]
    rows = [(names[k], c, float(full[j, k])) for j, c in enumerate(classes) for k in range(len(names))]
    return x.sparkSession.createDataFrame(rows, COEF_SCHEMA)


def coef_table(coef: DataFrame, group: str, label: str, covs: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """(cov, class, beta) → one scoring row (group, b[class][cov])."""
    pick = F.array(*[
        F.array(*[F.coalesce(F.max(F.when((F.col("cov") == k) & (F.col("class") == c), F.col("beta"))), F.lit(0.0)) for k in covs])
        for c in classes
    ])
    return coef.agg(pick.alias("b")).select(F.lit(label).alias(group), "b")


def fit_composition(
    x: DataFrame, y: DataFrame, row: str, cols: Sequence[str], classes: Sequence[str], group: str, groups: Sequence[str], cls: str = "class", value: str = "value"
) -> DataFrame:
    """Composition contrasts: pseudo-counts as weights, group intercepts as dummies (first group as base), zero-sum δ."""
    counts = to_pseudocounts(y, [row], cls, value)
    dummies = {f"{group}={g}": (F.col(group) == g).cast("double") for g in groups[1:]}
    design = x.withColumns(dummies)
    coef = fit_share_logit(design, counts, row, [*cols, *dummies], classes, "count", cls, reg=1e-4)
    return coef.where(F.col("cov").isin("intercept", *cols))


# ---- counts ----------------------------------------------------------------------------------------------------


def fit_count(df: DataFrame, y: str, cols: Sequence[str], offset: str) -> tuple[DataFrame, float]:
    """Poisson regression with log link and offset; dispersion r by moments of the squared residuals.

    Returns (cov, beta) and r of the variance μ + μ² / r (infinite when the data show no overdispersion).
    """
    clean = df.select(
        F.col(y).cast("double").alias("_y"), F.col(offset).cast("double").alias("_o"),
        *[finite_or(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols],
    )
    train = VectorAssembler(inputCols=list(cols), outputCol="_x").transform(clean).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        glm = GeneralizedLinearRegression(
            featuresCol="_x", labelCol="_y", offsetCol="_o", family="poisson", link="log", maxIter=25, regParam=0.0
        )
        model = glm.fit(train.select("_x", "_y", "_o"))
        eta = F.lit(float(model.intercept)) + F.col("_o")
        for c, b in zip(cols, model.coefficients):
            eta = eta + F.lit(float(b)) * F.col(c)
        mu = F.exp(eta)
        alpha = train.agg(
            (F.sum(((F.col("_y") - mu) * (F.col("_y") - mu) - mu) / (mu * mu)) / F.greatest(F.count(F.lit(1)) - len(cols) - 1, F.lit(1))).alias("a")
        ).first()["a"]
    finally:
        train.unpersist()
    rows = [("intercept", float(model.intercept)), *[(c, float(b)) for c, b in zip(cols, model.coefficients)]]
    table = df.sparkSession.createDataFrame(rows, "cov string, beta double")
    return table, (1.0 / alpha if alpha and alpha > 0 else float("inf"))


# ---- partial pooling -------------------------------------------------------------------------------------------


def partial_pooling(df: DataFrame, group: str, y: str, x: str | None = None) -> DataFrame:
    """Per-group mean (or slope on ``x``), shrunk to the precision-weighted pooled value.

    Groups are reduced to sufficient statistics in one aggregate.  The between-group variance is the moment estimate of
    DerSimonian and Laird; a group's weight on its own estimate is τ² / (τ² + se²).  A group that says nothing about its own
    error (one row, no variance, two rows for a slope) takes the pooled value.
    """
    yy = F.col(y)
    if x is None:
        s = df.groupBy(group).agg(F.count(yy).alias("n"), F.avg(yy).alias("estimate"), F.var_samp(yy).alias("_v"))
        s = s.withColumn("se2", F.try_divide("_v", "n")).drop("_v")
    else:
        xx = F.col(x)
        s = df.where(xx.isNotNull() & yy.isNotNull()).groupBy(group).agg(
            F.count(yy).alias("n"), F.covar_samp(xx, yy).alias("_c"), F.var_samp(xx).alias("_vx"), F.var_samp(yy).alias("_vy")
        )
        slope = F.try_divide("_c", "_vx")
        resid = F.try_divide((F.col("_vy") - slope * F.col("_c")) * (F.col("n") - 1), F.when(F.col("n") > 2, F.col("n") - 2))
        s = s.withColumn("estimate", slope)
        s = s.withColumn("se2", F.try_divide(resid, F.col("_vx") * (F.col("n") - 1))).drop("_c", "_vx", "_vy")
    s = s.withColumn("_w", F.when(F.col("se2") > 0, 1 / F.col("se2")))
    s = with_group_values(
        s, [], _sw=F.sum("_w"), _sw2=F.sum(F.col("_w") * F.col("_w")), _swe=F.sum(F.col("_w") * F.col("estimate")),
        _swee=F.sum(F.col("_w") * F.col("estimate") * F.col("estimate")), _k=F.count("_w"),
    )
    q = F.col("_swee") - F.col("_swe") * F.col("_swe") / F.col("_sw")
    tau2 = F.greatest(F.try_divide(q - (F.col("_k") - 1), F.col("_sw") - F.col("_sw2") / F.col("_sw")), F.lit(0.0))
    s = s.withColumn("tau2", F.coalesce(tau2, F.lit(0.0))).withColumn("_w2", F.when(F.col("_w").isNotNull(), 1 / (F.col("se2") + F.col("tau2"))))
    s = with_group_values(s, [], _pw=F.sum("_w2"), _pe=F.sum(F.col("_w2") * F.col("estimate")))
    pooled = F.col("_pe") / F.col("_pw")
    own = F.try_divide(F.col("tau2"), F.col("tau2") + F.col("se2"))
    return s.select(
        group, "n", "estimate", "se2", "tau2", pooled.alias("pooled"), 
        F.when(F.col("_w").isNull(), pooled).otherwise(own * F.col("estimate") + (1 - own) * pooled).alias("shrunk"),
    )


# ---- nested fits -----------------------------------------------------------------------------------------------


def fit_nested(
    x: DataFrame, y: DataFrame, row: str, cols: Sequence[str], paths: Paths, share: str = "share", cls: str = "class", min_rows: int = 50, max_iter: int = 60
) -> DataFrame:
    """Nested logit fitted leaf to root; each node is a share logit over its children.

    The inclusive value of a fitted child enters its parent as column ``IV_<child>``.  Nodes below ``min_rows`` rows are
    left without coefficients and split evenly.  Returns (node, child, cov, beta).
    """
    steps = edges(paths)
    spark = x.sparkSession
    depth_of = {n: d for _, n, _, d in steps}
    children: dict[str, list[str]] = {}
    for _, n, c, _ in steps:
        if c not in children.setdefault(n, []):
            children[n].append(c)
    shares = node_shares(y, [row], cls, share, paths, min_rows)
    rows = {r["node"]: r["n_rows"] for r in shares.groupBy("node").agg(F.max("n_rows").alias("n_rows")).collect()}
    design, fitted, out = x, set(), []
    for node in sorted(children, key=lambda n: (-depth_of[n], n)):
        kids = children[node]
        ivs = [f"IV_{c}" for c in kids if c in fitted]
        if rows.get(node, 0) < min_rows or len(kids) < 2:
            continue
        part = shares.where(F.col("node") == node).select(row, F.col("child").alias("class"), F.col("share"))
        coef = fit_share_logit(design, part, row, [*cols, *ivs], kids, max_iter=max_iter)
        values = [(r["cov"], r["class"], r["beta"]) for r in coef.collect()]
        out += [(node, c, k, b) for k, c, b in values]
        if node != "root":
            u = {c: F.lit(0.0) for c in kids}
            for k, c, b in values:
                u[c] = u[c] + F.lit(b) * (F.lit(1.0) if k == "intercept" else F.col(k))
            top = F.greatest(*u.values())
            iv = top + F.log(sum((F.exp(v - top) for v in u.values()), F.lit(0.0)))
            design = design.withColumn(f"IV_{node}", iv)
            fitted.add(node)
    return spark.createDataFrame(out, "node string, child string, cov string, beta double")


# ---- replicate draws -------------------------------------------------------------------------------------------


# Cumulative probabilities of a Poisson variable with mean 1, as far as a 52-bit uniform can tell them from 1.
POISSON_CUM = [c for c in itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(20)) if c < 1 - 2.0**-53]


def poisson_weight(seed: int, *cols: str) -> Column:
    """Reproducible Poisson(1) bootstrap weight from a hash of the key."""
    u = (hash_order(seed, *cols) + F.lit(0.5)) / F.lit(float(2**HASH_BITS))
    return sum(((u > c).cast("int") for c in POISSON_CUM), F.lit(0)).cast("double")


def bootstrap_draws(
    x: DataFrame, y: DataFrame, row: str, cols: Sequence[str], classes: Sequence[str], replicates: int, seed: int, max_iter: int = 40
) -> DataFrame:
    """Draw table from a weighted bootstrap: every replicate refits the share logit with Poisson row weights."""
    out = None
    # every replicate reads them; the weights are hashed once, before anything filters by them
    weights = [poisson_weight(seed + r, row).cast("tinyint").alias(f"_bw{r}") for r in range(1, replicates + 1)]
    x, y = written(x.select(row, *cols)), written(y.select(row, "class", "share", *weights))
    for r in range(1, replicates + 1):
        w = y.withColumn("_sw", F.col("share") * F.col(f"_bw{r}"))
        coef = fit_share_logit(x, w, row, cols, classes, "_sw", max_iter=max_iter)
        part = coef.select("cov", "class", F.lit(1).alias("chain"), F.lit(r).alias("iter"), F.col("beta").alias("value"))
        out = part if out is None else out.unionByName(part)
    release(x, y)
    return out


def compare_arms(
    x: DataFrame, y: DataFrame, row: str, base: Sequence[str], extra: Sequence[str], classes: Sequence[str], train: Column, max_iter: int = 60
) -> DataFrame:
    """Fit with and without a covariate block on training rows and compare on the common held-out rows, per class."""
    preds = []
    # both arms read them, and the comparison once more
    x, y = written(x.select(row, *dict.fromkeys([*base, *extra]), train.alias("_train"))), written(y.select(row, "class", "share"))
    for cols in (list(base), [*base, *extra]):
        coef = fit_share_logit(x.where("_train"), y, row, cols, classes, max_iter=max_iter)
        table = coef_table(coef, "_g", "__pooled__", ["intercept", *cols], classes)
        rows = feature_array(x.where("not _train").withColumn("intercept", F.lit(1.0)).withColumn("_g", F.lit("all")), ["intercept", *cols])
        p = explode_classes(predict_shares(rows, table, "_g"), [row], "p", classes, "pred")
        obs = y.select(row, "class", F.col("share").alias("obs"))
        preds.append(p.join(obs, [row, "class"], "left").fillna(0.0, ["obs"]))
    out = written(compare_fits(preds[0], preds[1], [row], "class", "obs", "pred"))  # a row for each class
    release(x, y)
    return out


# ---- intercepts given slopes -----------------------------------------------------------------------------------


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _newton_step(a: pd.Series, g: pd.Series, h: pd.Series) -> pd.Series:
    """New intercepts of one (group, draw): ridge Newton step with its length limited; the last class stays at 0."""
    out = []
    for ai, gi, hi in zip(a, g, h):
        grad = np.asarray(gi, dtype=float)
        hess = np.asarray(hi, dtype=float).reshape(len(grad), len(grad)) + 1e-6 * np.eye(len(grad))
        step = np.linalg.solve(hess, grad)
        longest = np.abs(step).max()
        step = step * min(1.0, 2.0 / longest) if longest > 0 else step
        out.append(list(np.asarray(ai, dtype=float) - np.append(step, 0.0)))
    return pd.Series(out)


def solve_intercepts(df: DataFrame, keys: Sequence[str], u: str, y: str, n_classes: int, iterations: int = 60, tolerance: float = 1e-10) -> DataFrame:
    """Class intercepts per key given slope utilities (arrays ``u`` and ``y`` per row); the last class is the baseline.

    Each Newton iteration sums gradient and Hessian over rows by partial aggregation; only the small per-key systems are
    solved one by one, and the intercept table is checkpointed between iterations.  Iterations end when no intercept moves by more
    than ``tolerance``; running out of them is an error.
    """
    j = n_classes
    data = written(df.select(*keys, u, y))  # every iteration reads it
    state = data.select(*keys).distinct().withColumn("a", F.array(*[F.lit(0.0)] * j))
    for _ in range(iterations):
        rows = data.join(state, list(keys)).withColumns({f"_u{i}": F.col(u)[i] + F.col("a")[i] for i in range(j)})
        top = F.greatest(*[F.col(f"_u{i}") for i in range(j)]) if j > 1 else F.col("_u0")
        rows = rows.withColumn("_top", top).withColumns({f"_e{i}": F.exp(F.col(f"_u{i}") - F.col("_top")) for i in range(j)})
        rows = rows.withColumn("_s", sum((F.col(f"_e{i}") for i in range(j)), F.lit(0.0))).withColumns({f"_p{i}": F.col(f"_e{i}") / F.col("_s") for i in range(j)})
        grad = [F.sum(F.col(f"_p{i}") - F.col(y)[i]).alias(f"_g{i}") for i in range(j - 1)]
        hess = [
            F.sum((F.col(f"_p{i}") if i == k else F.lit(0.0)) - F.col(f"_p{i}") * F.col(f"_p{k}")).alias(f"_h{i}_{k}")
            for i in range(j - 1) for k in range(i, j - 1)
        ]
        sums = rows.groupBy(*keys, "a").agg(*grad, *hess)
        g = F.array(*[F.col(f"_g{i}") for i in range(j - 1)])
        h = F.array(*[F.col(f"_h{min(i, k)}_{max(i, k)}") for i in range(j - 1) for k in range(j - 1)])
        moved = sums.select(*keys, F.col("a").alias("_old"), _newton_step("a", g, h).alias("a"))
        longest = F.array_max(F.zip_with("a", "_old", lambda s, t: F.abs(s - t)))
        moved = cut_lineage(moved.select(*keys, "a", longest.alias("_d")))
        state, step = moved.drop("_d"), moved.agg(F.max("_d")).first()[0]
        if step is None or step <= tolerance:
            release(data)
            return state
    raise RuntimeError(f"intercepts still move by {step} after {iterations} iterations")

