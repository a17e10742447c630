"""Neighbourhood operators on a regular lattice; all are fixed-size fan-outs followed by one aggregation."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.functions.scalar import normal_upper_tail
from gridpanel.operators.joins import distance_band, neighbour_offsets
from gridpanel.operators.windows import grid_bins
from gridpanel.plans.skew import range_bucketed, with_group_values

CELL = "__cell__"  # marker class: one row per occupied cell, used to count neighbours


def infer_resolution(df: DataFrame, coord: Sequence[str]) -> DataFrame:
    """Smallest positive gap between distinct coordinates, over all axes (one row).

    The distinct values of the axes are dealt by range: a task finds the gaps inside a range, and those between neighbouring ranges follow from the
    ends of the ranges. Null coordinates do not count; without two different values the result is NULL.
    """
    axes = F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), F.col(c).cast("double").alias("v")) for i, c in enumerate(coord)]))
    values = df.select(axes.alias("_a")).select("_a.*").where(F.col("v").isNotNull()).distinct()
    dealt = range_bucketed(values, ["axis"], ["v"])
    gap = F.col("v") - F.lag("v").over(Window.partitionBy("axis", "_b").orderBy("v"))
    inside = dealt.select(gap.alias("gap")).agg(F.min("gap").alias("gap"))
    ends = dealt.groupBy("axis", "_b").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    between = ends.select((F.col("lo") - F.lag("hi").over(Window.partitionBy("axis").orderBy("_b"))).alias("gap"))  # a row per range
    return inside.unionAll(between).agg(F.min("gap").alias("res"))


def lattice_index(x: str, y: str, res: float, x0: float = 0.0, y0: float = 0.0) -> tuple[Column, Column]:
    ix = F.round((F.col(x) - x0) / res).cast("long")
    return ix, F.round((F.col(y) - y0) / res).cast("long")


def tile_key(ix: str, iy: str, side: int) -> Column:
    bx, by = (F.floor(F.col(c) / side) for c in (ix, iy))
    return F.concat_ws("_", bx.cast("string"), by.cast("string"))


def cell_shares(df: DataFrame, by: Sequence[str], ix: str, iy: str, cls: str, area: str) -> DataFrame:
    """One row per (cell, class) with the class share of the cell; duplicates on a coordinate are summed first."""
    keys = [*by, ix, iy]
    sums = df.groupBy(*keys, cls).agg(F.sum(area).alias("_a"))
    total = F.sum("_a").over(Window.partitionBy(*keys))
    share = F.when(total > 0, F.col("_a") / F.nullif(total, F.lit(0.0))).otherwise(F.lit(0.0))
    return sums.select(*keys, cls, share.alias("share"))


TILE = 64  # side of the tiles that neighbourhood work is shuffled by, in cells


def with_halo(df: DataFrame, by: Sequence[str], ix: str, iy: str, reach: int, side: int = TILE) -> DataFrame:
    """Repartition lattice rows by tile, with copies of the border rows in the tiles they can reach.

    Adds the tile ``_tx, _ty`` a copy sits in.  A neighbourhood of ``reach`` cells is then complete inside the partition of
    its home tile, so window sums need no further shuffle: about 1 + 4·reach / side copies of a row travel instead of one
    per neighbour.
    """
    def tiles(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side))

    out = df.withColumn("_tx", F.explode(tiles(ix))).withColumn("_ty", F.explode(tiles(iy)))
    return out.repartition(*by, "_tx", "_ty")


def at_home(ix: str, iy: str, side: int = TILE) -> Column:
    """Whether a target cell belongs to the tile it was computed in."""
    return (F.floor(F.col(ix) / side) == F.col("_tx")) & (F.floor(F.col(iy) / side) == F.col("_ty"))


def shifted(df: DataFrame, offsets: Column, ix: str, iy: str) -> DataFrame:
    """Send every row to the cells at the given offsets; ``_own`` is 1 on the copy that stays."""
    out = df.withColumn("_o", F.explode(offsets))
    own = ((F.col("_o.dx") == 0) & (F.col("_o.dy") == 0)).cast("int")
    return out.withColumns({
        "_own": own, ix: F.col(ix) + F.col("_o.dx"), iy: F.col(iy) + F.col("_o.dy"),
    }).where(at_home(ix, iy)).drop("_o")


def focal_mean(
    df: DataFrame, by: Sequence[str], ix: str, iy: str, cls: str, area: str, complete_only: bool = True
) -> DataFrame:
    """Mean class share of the eight neighbours of every occupied cell (long; absent classes are 0 and not emitted).

    With ``complete_only`` a cell without all eight neighbours gets no rows, which means 0 everywhere.  A marker row per
    cell counts neighbours and shows which targets exist.  After the tile shuffle, class sums and counts are local.
    """
    keys = [*by, ix, iy]
    shares = cell_shares(df, by, ix, iy, cls, area)
    # the marker comes from the first class row of a cell, so the shares are computed once
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(cls)) == 1
    shares = shares.withColumn("_first", first)
    rows = F.when(
        F.col("_first"), F.array(F.struct(F.col(cls).alias("c"), F.col("share").alias("s")), F.struct(F.lit(CELL).alias("c"), F.lit(1.0).alias("s")))
    ).otherwise(F.array(F.struct(F.col(cls).alias("c"), F.col("share").alias("s"))))
    marked = shares.select(*keys, F.explode(rows).alias("_r")).select(*keys, F.col("_r.c").alias(cls), F.col("_r.s").alias("share"))
    moved = shifted(with_halo(marked, by, ix, iy, 1), neighbour_offsets(1, centre=True), ix, iy)
    near = F.sum(F.when(F.col("_own") == 0, F.col("share")))
    sums = moved.groupBy(*by, "_tx", "_ty", ix, iy, cls).agg(near.alias("_s"), F.max("_own").alias("_own"))
    cell = Window.partitionBy(*by, "_tx", "_ty", ix, iy)
    n = F.max(F.when(F.col(cls) == CELL, F.col("_s"))).over(cell)
    here = F.max(F.when(F.col(cls) == CELL, F.col("_own"))).over(cell)
    out = sums.withColumn("n_neighbours", n.cast("long")).withColumn("_here", here)
    out = out.where((F.col(cls) != CELL) & (F.col("_here") == 1) & F.col("_s").isNotNull())
    if complete_only:
        out = out.where(F.col("n_neighbours") == 8)
    return out.select(*keys, cls, (F.col("_s") / F.col("n_neighbours")).alias("focal"), "n_neighbours")


def focal_columns(
    cells: DataFrame, by: Sequence[str], ix: str, iy: str, classes: Sequence[str], nodata: bool = False
) -> DataFrame:
    """Add ``focal_<class>`` (complete neighbourhoods only, else 0) to a wide table of class areas.

    With a known class list a cell travels as one row of shares; several rows on a coordinate are summed first.
    """
    keys = [*by, ix, iy]
    sums = cells.groupBy(*keys).agg(*[F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in classes])
    total = sum((F.col(c) for c in classes), F.lit(0.0))
    shares = sums.select(*keys, *[F.when(total > 0, F.col(c) / F.nullif(total, F.lit(0.0))).otherwise(F.lit(0.0)).alias(f"_s_{c}") for c in classes])
    moved = shifted(with_halo(shares, by, ix, iy, 1), neighbour_offsets(1, centre=True), ix, iy)
    away = F.col("_own") == 0
    near = moved.groupBy(*by, "_tx", "_ty", ix, iy).agg(
        F.count(F.when(away, 1)).alias("_n"), F.max("_own").alias("_own"),
        *[F.sum(F.when(away, F.col(f"_s_{c}")).otherwise(0.0)).alias(f"_s_{c}") for c in classes],
    ).where(F.col("_own") == 1)
    names = [f"focal_{c}" for c in classes]
    near = near.select(*keys, *[F.when(F.col("_n") == 8, F.col(f"_s_{c}") / 8).otherwise(F.lit(0.0)).alias(f"focal_{c}") for c in classes])
    out = cells.drop(*names).join(near, keys, "left").fillna(0.0, names)
    return out.withColumn("focal_NODATA", nodata_share(*[F.col(n) for n in names])) if nodata else out


def focal_wide(focal: DataFrame, cells: DataFrame, keys: Sequence[str], cls: str, classes: Sequence[str], nodata: bool) -> DataFrame:
    """``focal_<class>`` columns for every cell, zero-filled, optionally with the uncovered share ``focal_NODATA``."""
    wide = focal.groupBy(*keys).agg(
        *[F.sum(F.when(F.col(cls) == c, F.col("focal")).otherwise(0.0)).alias(f"focal_{c}") for c in classes]
    )
    names = [f"focal_{c}" for c in classes]
    out = cells.join(wide, list(keys), "left").fillna(0.0, names)
    return out.withColumn("focal_NODATA", nodata_share(*[F.col(n) for n in names])) if nodata else out


def nodata_share(*focal: Column) -> Column:
    total = F.lit(0.0)
    for c in focal:
        total = total + c
    return F.greatest(F.lit(1.0) - total, F.lit(0.0))


# ---- generic moving window -------------------------------------------------------------------------------------


def window_weights(w: int, decay: str = "none", p: float = 1.0, include_center: bool = False) -> dict[tuple[int, int], float]:
    """Weights of an odd window by distance decay."""
    if w % 2 == 0:
        raise ValueError("window size must be odd")
    half = w // 2
    out = {}
    for dx in range(-half, half + 1):
        for dy in range(-half, half + 1):
            d = math.hypot(dx, dy)
            if decay == "none":
                weight = 1.0
            elif decay == "inverse":
                weight = 1.0 / (d + 1e-6) ** p
            elif decay == "exponential":
                weight = math.exp(-p * d)
            else:
                raise ValueError(f"unknown decay {decay!r}")
            if (dx, dy) != (0, 0) or include_center:
                out[(dx, dy)] = weight
    return out


# Aggregates a window can use; ``values`` is the array of weighted neighbour values of one cell (at most one window).
WINDOW_FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "min": F.array_min,
    "max": F.array_max,
    "median": lambda v: _array_median(v),
    "modal": lambda v: _array_mode(v),
}


def register_window_function(name: str, fn: Callable[[Column], Column]) -> None:
    """Register a user function from an array of neighbour values to one value."""
    WINDOW_FUNCTIONS[name] = fn


def _array_median(v: Column) -> Column:
    s, n = F.array_sort(v), F.size(v)
    mid = F.floor((n - 1) / 2).cast("int")
    upper = F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(s, mid) + F.get(s, upper)) / 2)


def _array_mode(v: Column) -> Column:
    counted = F.transform(F.array_distinct(v), lambda d: F.struct(
        (-F.size(F.filter(v, lambda e: e == d))).alias("n"), d.alias("v")))
    return F.array_min(counted)["v"]


def focal_window(
    df: DataFrame,
    by: Sequence[str],
    ix: str,
    iy: str,
    value: str,
    weights: dict[tuple[int, int], float],
    fun: str = "mean",
    fill: float | None = None,
    na_rm: bool = True,
    out: str | None = None,
) -> DataFrame:
    """Moving window over occupied cells (one value per cell).

    ``mean`` and ``sum`` add value × weight, the mean with weights normalised by the whole kernel, so border cells are
    attenuated.  Other functions see the array of weighted neighbour values.  ``fill`` stands in for positions outside;
    without it they are skipped, or make the result NULL when ``na_rm`` is off.
    """
    keys = [*by, ix, iy]
    kernel = {o: w for o, w in weights.items() if w > 0}
    total = sum(kernel.values())
    scale = total if fun == "mean" and total > 0 else 1.0
    # value at offset o counts for the cell at position − o
    arms = F.array(
        *[
            F.struct(F.lit(-dx).cast("long").alias("dx"), F.lit(-dy).cast("long").alias("dy"), F.lit(w / scale).alias("w"))
            for (dx, dy), w in kernel.items()
        ]
    )
    reach = max(max(abs(dx), abs(dy)) for dx, dy in kernel)
    src = df.select(*keys, F.col(value).cast("double").alias("_v"))
    # one more arm without weight marks the cell itself, so that targets need no join
    mark = F.array(F.struct(F.lit(0).cast("long").alias("dx"), F.lit(0).cast("long").alias("dy"), F.lit(None).cast("double").alias("w")))
    sent = with_halo(src, by, ix, iy, reach).withColumn("_o", F.explode(F.concat(arms, mark)))
    sent = sent.select(
        *by,
        "_tx",
        "_ty",
        (F.col(ix) + F.col("_o.dx")).alias(ix),
        (F.col(iy) + F.col("_o.dy")).alias(iy),
        (F.col("_v") * F.col("_o.w")).alias("_x"),
        F.when(F.col("_v").isNotNull(), F.col("_o.w")).alias("_w"),
        F.col("_o.w").isNull().alias("_own"),
    ).where(at_home(ix, iy))
    simple = fun in ("mean", "sum")
    measure = F.sum("_x").alias("_r") if simple else F.collect_list("_x").alias("_r")
    cells = sent.groupBy(*by, "_tx", "_ty", ix, iy).agg(
        measure, F.count("_x").alias("_n"), F.sum("_w").alias("_wsum"), F.max("_own").alias("_own")
    ).where(F.col("_own"))
    missing = F.lit(len(kernel)) - F.coalesce(F.col("_n"), F.lit(0)).cast("int")
    if simple:
        result = F.col("_r")
        if fill is not None:
            gap = F.lit(total / scale) - F.coalesce(F.col("_wsum"), F.lit(0.0))
            result = F.coalesce(result, F.lit(0.0)) + gap * F.lit(float(fill))
    else:
        values = F.col("_r")
        if fill is not None:
            values = F.concat(values, F.array_repeat(F.lit(float(fill)), missing))
        result = WINDOW_FUNCTIONS[fun](values)
    if not na_rm and fill is None:
        result = F.when(missing == 0, result)
    return cells.select(*keys, result.alias(out or f"{value}_focal_{fun}"))


# ---- buffers, autocorrelation, maps ----------------------------------------------------------------------------


def buffer_ring(cells: DataFrame, chosen: DataFrame, ix: str, iy: str, reach: int) -> DataFrame:
    """Cells within ``reach`` of a chosen cell that are not chosen themselves."""
    seeds = chosen.select(ix, iy).distinct()
    near = seeds.withColumn("_o", F.explode(neighbour_offsets(reach))).select(
        (F.col(ix) + F.col("_o.dx")).alias(ix), (F.col(iy) + F.col("_o.dy")).alias(iy)
    ).distinct()
    return cells.join(near, [ix, iy], "left_semi").join(seeds, [ix, iy], "left_anti")


def morans_i(df: DataFrame, x: str, y: str, value: str, band: float) -> DataFrame:
    """Moran's I with row-standardised weights over all observations no farther apart than ``band``.

    Observations without neighbours keep weight 0.  The p-value is one-sided under randomisation.  Observations on one
    position are reduced to their moments first; pairs are formed between positions only.
    """
    src = df.where(F.col(value).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    src = with_group_values(src.select(x, y, value), [], _m=F.avg(value), _n=F.count(value))
    z = F.col(value) - F.col("_m")
    pos = src.groupBy(x, y).agg(
        F.count(F.lit(1)).alias("c"), F.sum(z).alias("z1"), F.sum(z * z).alias("z2"), F.sum(z * z * z * z).alias("z4")
    ).withColumn("pid", F.struct(F.col(x), F.col(y)))
    pairs = distance_band(pos, x, y, "pid", band).select(F.col("id_a").alias("pid"), "id_b")
    other = pos.select(F.col("pid").alias("id_b"), F.col("c").alias("c_b"), F.col("z1").alias("z_b"))
    linked = pairs.join(other, "id_b")
    # k: neighbours of one observation on the position, itself left out; s: sum of their values plus its own
    near = linked.groupBy("pid").agg((F.sum("c_b") - 1).alias("k"), F.sum("z_b").alias("s"))
    pos = pos.join(near, "pid")
    inv = F.when(F.col("k") > 0, F.lit(1.0) / F.nullif(F.col("k"), F.lit(0))).otherwise(F.lit(0.0))
    pos = pos.withColumn("inv", inv)
    # column sums of the weight matrix, and Σ (w_ij + w_ji)² over ordered pairs
    b = pos.select(F.col("pid").alias("id_b"), F.col("c").alias("c_b"), F.col("inv").alias("inv_b"))
    a = pos.select("pid", F.col("c").alias("c_a"), F.col("inv").alias("inv_a"))
    cross = pairs.join(b, "id_b").join(a, "pid")
    same = F.col("pid") == F.col("id_b")
    count = F.when(same, F.col("c_a") * (F.col("c_a") - 1)).otherwise(F.col("c_a") * F.col("c_b"))
    pair_w = (F.col("inv_a") + F.col("inv_b")) * (F.col("inv_a") + F.col("inv_b"))
    # the two matrix sums come from one aggregate per position, then one over all
    per_pos = cross.groupBy("pid").agg(F.sum(count * pair_w).alias("s1"), F.sum(F.col("c_b") * F.col("inv_b")).alias("colsum"))
    pos = pos.join(per_pos, "pid")
    rowsum = F.when(F.col("k") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    col_one = F.col("colsum") - F.col("inv")
    lag = (F.col("s") * F.col("z1") - F.col("z2")) * F.col("inv")
    tot = pos.agg(
        F.sum("c").cast("double").alias("n_all"),
        F.sum(F.when(F.col("k") > 0, F.col("c")).otherwise(0)).cast("double").alias("n"),
        F.sum(lag).alias("num"),
        F.sum("z2").alias("m2"),
        F.sum("z4").alias("m4"),
        (F.sum("s1") / 2).alias("S1"),
        F.sum(F.col("c") * (rowsum + col_one) * (rowsum + col_one)).alias("S2"),
    )
    n, s0 = F.col("n"), F.col("n")
    stat = F.try_divide(n, s0) * F.try_divide(F.col("num"), F.col("m2"))
    k4 = F.try_divide(n * F.col("m4"), F.col("m2") * F.col("m2"))
    expected = F.try_divide(F.lit(-1.0), n - 1)
    first = n * (F.col("S1") * (n * n - 3 * n + 3) - n * F.col("S2") + 3 * s0 * s0)
    second = k4 * (F.col("S1") * (n * n - n) - 2 * n * F.col("S2") + 6 * s0 * s0)
    var = F.try_divide(first - second, (n - 1) * (n - 2) * (n - 3) * s0 * s0) - expected * expected
    out = tot.select(
        F.col("n_all").cast("long").alias("n_obs"),
        (F.col("n_all") - n).cast("long").alias("n_isolated"),
        stat.alias("moran_i"),
        expected.alias("expected"),
        var.alias("variance"),
    )
    zscore = F.try_divide(F.col("moran_i") - F.col("expected"), F.sqrt(F.col("variance")))
    return out.withColumn("p_value", normal_upper_tail(zscore))


def tvd_map(df: DataFrame, x: str, y: str, tvd: str, side: int = 44, min_count: int = 3) -> DataFrame:
    """Mean total variation distance on a coarse grid."""
    return grid_bins(df, x, y, tvd, side, min_count)


def route_focal(focal: DataFrame, keys: Sequence[str], cls: str, value: str, parents: DataFrame, rule: str = "macro_totals") -> DataFrame:
    """Collapse the fine focal columns of routed children into ``<child>_tot``, or drop them.

    ``parents`` maps a fine class to its routed child; classes not listed pass through.
    """
    if rule == "flat":
        return focal
    mapped = focal.join(parents.select(F.col("class").alias(cls), "child"), cls, "left")
    if rule == "drop":
        return mapped.where(F.col("child").isNull()).drop("child")
    if rule != "macro_totals":
        raise ValueError(f"unknown rule {rule!r}")
    name = F.coalesce(F.concat(F.col("child"), F.lit("_tot")), F.col(cls))
    return mapped.withColumn(cls, name).groupBy(*keys, cls).agg(F.sum(value).alias(value))


def prefixed(df: DataFrame, cols: Sequence[str], prefix: str) -> DataFrame:
    """Carry class columns under a ``focal_`` or ``prev_`` prefix."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in cols})
