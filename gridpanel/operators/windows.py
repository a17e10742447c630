"""Ranking, running shares, lagged state, binning and autocovariance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.plans.skew import dense_index, group_quantiles, join_null_safe, keyed, with_group_values


def top_by_count(df: DataFrame, key: str, label: str) -> DataFrame:
    """The label seen most often per key; ties go to the first name."""
    counts = df.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct(label, "n"), F.struct((-F.col("n")).alias("a"), F.col(label).alias("b")))
    return counts.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def prevalence_curve(df: DataFrame, cls: str, area: str) -> DataFrame:
    """Class share of the total, sorted from the largest, with its running sum (one row per class)."""
    sums = df.groupBy(cls).agg(F.sum(area).alias("_a"))
    total = F.sum("_a").over(Window.partitionBy())
    shares = sums.select(cls, (F.col("_a") / total).alias("share"))
    order = Window.orderBy(F.desc("share"), F.asc(cls)).rowsBetween(Window.unboundedPreceding, 0)
    return shares.withColumn("cum", F.sum("share").over(order))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Latest row per key by an explicit order."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def group_share(df: DataFrame, keys: Sequence[str], value: str, out: str = "share") -> DataFrame:
    """Share of a row in its group total; the total comes from an aggregate and a join, so a hot group stays spread."""
    df = with_group_values(df, keys, _total=F.sum(value))
    return df.withColumn(out, F.try_divide(F.col(value), F.col("_total"))).drop("_total")


def strongest_per_group(df: DataFrame, keys: Sequence[str], measure: str, label: str, cols: Sequence[str]) -> DataFrame:
    pick = F.min_by(F.struct(*cols), F.struct((-F.abs(F.col(measure))).alias("a"), F.col(label).alias("b")))
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, "_r.*")


def lagged_state(df: DataFrame, keys: Sequence[str], year: str, cols: Sequence[str], lag: int, prefix: str = "prev_") -> DataFrame:
    """Attach the same cell's values ``lag`` years earlier; a lag of 0 would feed the outcome to itself and is refused."""
    if lag <= 0:
        raise ValueError("the lagged state must lie before the outcome year")
    past = df.select(*keys, (F.col(year) + lag).alias(year), *[F.col(c).alias(f"{prefix}{c}") for c in cols])
    return df.join(past, [*keys, year], "left")


def quantile_bins(df: DataFrame, value: str, bins: int, out: str = "bin") -> DataFrame:
    """Bin by quantile cut points with duplicate cuts merged; bins are (low, high], the first includes its low end."""
    probs = {f"q{i:02d}": i / bins for i in range(bins + 1)}
    cuts = group_quantiles(df, [], value, probs)
    cuts = cuts.select(F.array_distinct(F.array(*probs)).alias("_cuts")).withColumn("_one", F.lit(1))
    x = F.col(value)
    below = F.size(F.filter(F.col("_cuts"), lambda c: c < x))
    joined = df.withColumn("_one", F.lit(1)).join(cuts, "_one").drop("_one")
    return joined.withColumn(out, F.greatest(below, F.lit(1))).drop("_cuts")


def fixed_bins(value: Column, width: float) -> Column:
    """Index of the fixed-width bin (low, high] on [0, 1]; 0 falls in the first bin."""
    return F.greatest(F.ceil(value / width), F.lit(1)).cast("int")


def grid_bins(df: DataFrame, x: str, y: str, value: str, side: int = 44, min_count: int = 3) -> DataFrame:
    """Mean of a value on an equal-width ``side`` × ``side`` grid; thin bins are left out."""
    df = with_group_values(df, [], _x0=F.min(x), _x1=F.max(x), _y0=F.min(y), _y1=F.max(y))

    def cell(c: str, low: str, high: str) -> Column:
        # intervals are (low, high] over the range, as an equal-width cut makes them
        step = (F.col(high) - F.col(low)) / side
        raw = F.ceil(F.try_divide(F.col(c) - F.col(low), step))
        return F.greatest(F.least(F.coalesce(raw, F.lit(1)), F.lit(side)), F.lit(1)).cast("int")

    binned = df.withColumn("bx", cell(x, "_x0", "_x1")).withColumn("by", cell(y, "_y0", "_y1"))
    out = binned.groupBy("bx", "by").agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= min_count)


def rarest(df: DataFrame, cls: str, area: str, k: int) -> DataFrame:
    return df.groupBy(cls).agg(F.sum(area).alias(area)).orderBy(F.asc(area), F.asc(cls)).limit(k)


def strength_order(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys ordered by the spread of their values."""
    out = df.groupBy(key).agg((F.max(value) - F.min(value)).alias("spread"))
    return out.orderBy(F.desc("spread"), F.asc(key))


def head_by(df: DataFrame, measure: str, label: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(measure), F.asc(label)).limit(k)


def centred_series(df: DataFrame, keys: Sequence[str], order: str, value: str, sparse: bool) -> DataFrame:
    """Series less their means: keys, ``_t`` from 1, ``_n`` values of the key, their mean ``_m``, ``_x``. With ``sparse`` any unique integer orders and is numbered here."""
    df = dense_index(df, keys, order, "_t") if sparse else df.withColumn("_t", F.col(order).cast("long"))
    df = with_group_values(df, keys, _m=F.avg(value), _n=F.count(value))
    return df.select(*keys, "_t", "_n", "_m", F.coalesce(F.col(value) - F.col("_m"), F.lit(0.0)).alias("_x"))


def lag_sums(series: DataFrame, keys: Sequence[str], low: int, high: int, block: int = 4096) -> DataFrame:
    """Σ x_t x_{t+k} / n of every key at lags ``low`` ≤ k < ``high``, one row per lag that occurs (``lag``, ``acov``).

    A series is cut into blocks of at least as many values as there are lags. A block gets its own values and those that lie ``low`` to ``high`` behind
    them, so a value travels at most four times and a task holds blocks, never a whole series. The products of a block are summed by Fourier transform.
    """
    lags = high - low
    block = max(block, lags)
    t = F.col("_t") - 1
    first = F.greatest(F.ceil((t - (block + high - 2)) / block), F.lit(0)).cast("long")
    last = F.floor((t - low) / block).cast("long")
    behind = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    own = F.floor(t / block).cast("long")
    dealt = series.select(*keys, "_t", "_n", "_x", F.explode(F.array_union(F.array(own), behind)).alias("_blk"))

    def products(part: pd.DataFrame) -> pd.DataFrame:
        at, x, start = part["_t"].to_numpy() - 1, part["_x"].to_numpy(float), int(part["_blk"].iloc[0]) * block

        def stretch(offset: int, length: int) -> np.ndarray:
            pos = at - offset
            inside = (pos >= 0) & (pos < length)
            out = np.zeros(pos[inside].max() + 1 if inside.any() else 0)
            out[pos[inside]] = x[inside]
            return out

        here, there = stretch(start, block), stretch(start + low, block + lags - 1)
        found = min(lags, len(there)) if len(here) else 0
        size = 1 << (len(here) + len(there)).bit_length()
        sums = np.fft.irfft(np.fft.rfft(here, size).conj() * np.fft.rfft(there, size), size)[:found] if found else np.zeros(0)
        return part[list(keys)].head(1).assign(_s=[sums / part["_n"].iloc[0]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.select(*keys).schema)
    blocks = dealt.groupBy(*keys, "_blk").applyInPandas(products, ", ".join(filter(None, [fields, "_s array<double>"])))
    by_lag = blocks.select(*keys, F.posexplode("_s").alias("_k", "_v"))
    return by_lag.groupBy(*keys, (F.col("_k") + F.lit(low)).alias("lag")).agg(F.sum("_v").alias("acov"))


def autocovariance(
    df: DataFrame, keys: Sequence[str], order: str, value: str, max_lag: int, block: int = 4096, sparse: bool = False
) -> DataFrame:
    """Autocovariance of a series per key at lags 0..max_lag: Σ (x_t − m)(x_{t+k} − m) / n, by blocks (``lag_sums``).

    ``order`` counts 1..n without gaps; with ``sparse`` it is any unique integer and is numbered here. Lags beyond a series have covariance 0.
    """
    df, ks = keyed(df, keys)
    series = centred_series(df, ks, order, value, sparse)
    sizes = series.groupBy(*ks).agg(F.max("_n").alias("n"))
    wanted = sizes.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_lag))))
    out = join_null_safe(wanted, lag_sums(series, ks, 0, max_lag + 1, block), [*ks, "lag"], "left")
    return out.select(*keys, "lag", F.coalesce("acov", F.lit(0.0)).alias("acov"), "n")
