"""Aggregations: sums, weighted moments, shares, diversity, checks, coverage, panels and livestock tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.functions.scalar import finite_or


class ConservationError(ValueError):
    """A step changed a total it must preserve."""


# ---- plain and weighted aggregates -----------------------------------------------------------------------------


def sum_area(df: DataFrame, keys: Sequence[str], area: str = "area") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(area).alias(area))


def sum_columns(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cols])


def weighted_mean(x: Column, w: Column) -> Column:
    """Σxw / Σw; a NULL value leaves together with its weight."""
    return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def weighted_sum(x: Column, w: Column) -> Column:
    return F.sum(x * w)


def weighted_sd(x: Column, w: Column) -> Column:
    """Weighted population standard deviation over finite values with positive weight; 0 below two values."""
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & w.isNotNull() & ~F.isnan(w) & (w > 0)
    xs, ws = F.when(ok, x), F.when(ok, w)
    mean = F.try_divide(F.sum(ws * xs), F.sum(ws))
    var = F.try_divide(F.sum(ws * xs * xs), F.sum(ws)) - mean * mean
    return F.when(F.count(xs) < 2, F.lit(0.0)).otherwise(F.sqrt(F.greatest(var, F.lit(0.0))))


def weighted_share(condition: Column, w: Column) -> Column:
    """Weighted fraction of rows for which the condition holds; NULL conditions leave with their weight."""
    return weighted_mean(condition.cast("double"), w)


def dominant(df: DataFrame, keys: Sequence[str], col: str, out: str | None = None) -> DataFrame:
    """Most frequent non-blank value per key; ties go to the smallest value.

    Counting by (key, value) first keeps a hot key spread over tasks.
    """
    used = df.where(F.col(col).isNotNull() & (F.col(col).cast("string") != ""))
    counts = used.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(F.col(col), F.struct((-F.col("_n")).alias("n"), F.col(col).alias("v")))
    return counts.groupBy(*keys).agg(best.alias(out or col))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """First row per key in an explicit order, as a partial aggregate rather than a sort of the whole group."""
    pick = F.min_by(F.struct(*cols), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, "_r.*")


def circular(sin: Column, cos: Column) -> tuple[Column, Column]:
    """Mean direction in [0, 360) degrees and circular variance from the mean sine and cosine."""
    s, c = F.avg(sin), F.avg(cos)
    return F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0)), F.lit(1.0) - F.sqrt(s * s + c * c)


# ---- compositions ----------------------------------------------------------------------------------------------


def to_shares(df: DataFrame, keys: Sequence[str], cls: str, area: str, out: str = "share") -> DataFrame:
    """Class sums per key and their share of the key total (0 when the total is 0).

    The table is first reduced to one row per (key, class), so the window holds at most one row per class.
    """
    sums = df.groupBy(*keys, cls).agg(F.sum(area).alias(area))
    total = F.sum(area).over(Window.partitionBy(*keys))
    return sums.withColumn(out, F.when(total != 0, F.col(area) / F.nullif(total, F.lit(0.0))).otherwise(F.lit(0.0)))


def category_shares(df: DataFrame, keys: Sequence[str], col: str, weight: str, out: str = "share") -> DataFrame:
    """Weighted share of each observed code inside the key; codes with no weight anywhere are dropped."""
    shares = to_shares(df.where(F.col(col).isNotNull()), keys, col, weight, out)
    live = shares.groupBy(col).agg(F.sum(weight).alias("_t")).where(F.col("_t") > 0).select(col)
    return shares.join(live, col, "left_semi")


def pivot_shares(df: DataFrame, keys: Sequence[str], col: str, share: str, codes: Sequence, prefix: str) -> DataFrame:
    """Wide share block ``<prefix>_s<code>`` with zero fill; the code list is explicit, so no extra job runs."""
    cols = [
        F.coalesce(F.sum(F.when(F.col(col) == c, F.col(share))), F.lit(0.0)).alias(f"{prefix}_s{c}") for c in codes
    ]
    return df.groupBy(*keys).agg(*cols)


def ref_diff(df: DataFrame, prefix: str) -> DataFrame:
    """Contrasts of a share block against its first column: ``<prefix>_s2`` → ``<prefix>_dev2`` and so on."""
    block = sorted(c for c in df.columns if c.startswith(f"{prefix}_s"))
    if len(block) < 2:
        return df
    ref = F.col(block[0])
    return df.withColumns({c.replace("_s", "_dev", 1): F.col(c) - ref for c in block[1:]})


def diversity(df: DataFrame, keys: Sequence[str], share: str = "share") -> DataFrame:
    """Richness, Shannon, Simpson and evenness from long shares."""
    p = F.col(share)
    base = df.groupBy(*keys).agg(
        F.count(F.when(p > 0, 1)).alias("richness"),
        (-F.sum(F.when(p > 0, p * F.log(F.when(p > 0, p))).otherwise(0.0))).alias("shannon"),
        (F.lit(1.0) - F.sum(p * p)).alias("simpson"),
    )
    even = F.when(F.col("richness") > 1, F.col("shannon") / F.log(F.col("richness").cast("double"))).otherwise(0.0)
    return base.withColumn("evenness", even)


# ---- checks ----------------------------------------------------------------------------------------------------


def assert_conserved(before: DataFrame, after: DataFrame, area: str, keys: Sequence[str] = (), tol: float = 1e-6) -> None:
    """Raise when a total (per key, or overall) moved by more than ``tol`` relative to the larger of 1 and the total."""
    ks = list(keys)
    a = before.groupBy(*ks).agg(F.sum(area).alias("_a"))
    b = after.groupBy(*ks).agg(F.sum(area).alias("_b"))
    if ks:
        both = a.join(b, ks, "full")
    else:
        both = a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k", "full")
    x, y = F.coalesce(F.col("_a"), F.lit(0.0)), F.coalesce(F.col("_b"), F.lit(0.0))
    bad = both.where(F.abs(x - y) > F.lit(tol) * F.greatest(F.lit(1.0), F.abs(x))).limit(5).collect()
    if bad:
        raise ConservationError(f"total of {area} not conserved: {bad}")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    bad = df.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if bad:
        raise ValueError(f"duplicate keys {list(keys)}: {bad}")


def assert_shares(df: DataFrame, keys: Sequence[str], share: str, tol: float = 0.05) -> None:
    bad = df.groupBy(*keys).agg(F.sum(share).alias("s")).where(F.abs(F.col("s") - 1) >= tol).limit(5).collect()
    if bad:
        raise ValueError(f"shares do not sum to 1: {bad}")


# ---- coverage and reports --------------------------------------------------------------------------------------


def group_coverage(
    df: DataFrame, frame: DataFrame, group: str, area: str, frame_area: str, min_share: float = 0.15, min_area: float = 100.0
) -> DataFrame:
    """Modelled against original area per group, with a ``keep`` flag."""
    modelled = df.groupBy(group).agg(F.sum(area).alias("modeled_area"))
    original = frame.groupBy(group).agg(F.sum(frame_area).alias("orig_area"))
    m = F.coalesce(F.col("modeled_area"), F.lit(0.0))
    return (
        modelled.join(original, group, "right")
        .withColumn("modeled_area", m)
        .withColumn("coverage", F.try_divide(m, F.col("orig_area")))
        .withColumn("keep", ~((F.col("coverage") < min_share) | (F.col("modeled_area") < min_area)))
    )


def coverage_filter(df: DataFrame, frame: DataFrame, group: str, area: str, frame_area: str, **limits) -> DataFrame:
    drop = group_coverage(df, frame, group, area, frame_area, **limits).where(~F.col("keep")).select(group)
    return df.join(drop, group, "left_anti")


def min_rows_filter(df: DataFrame, group: str, min_rows: int) -> DataFrame:
    """Coverage variant: keep groups with at least ``min_rows`` rows."""
    keep = df.groupBy(group).count().where(F.col("count") >= min_rows).select(group)
    return df.join(keep, group, "left_semi")


def area_report(df: DataFrame, levels: Sequence[str], area: str) -> DataFrame:
    """Totals at every level of a hierarchy (grand total included), plus smallest and largest row."""
    return df.rollup(*levels).agg(
        F.sum(area).alias("total_area"), F.min(area).alias("min_area"), F.max(area).alias("max_area")
    )


# ---- livestock tables ------------------------------------------------------------------------------------------


def collapse_preference(df: DataFrame, keys: Sequence[str], col: str, order: Sequence[str], value: str) -> DataFrame:
    """First non-null value by survey-round preference; rounds outside the list are ignored."""
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(col))
    used = df.where(F.col(col).isin(*order))
    best = F.min_by(F.col(value), F.when(F.col(value).isNotNull(), rank))
    return used.groupBy(*keys).agg(best.alias(value))


def to_heads(df: DataFrame, unit: str, value: str) -> DataFrame:
    return df.withColumn(value, F.when(F.col(unit) == "THS_HD", F.col(value) * 1000).otherwise(F.col(value)))


def code_sum(code: str, value: str, member: str) -> Column:
    """Value of one code inside a group, NULL when the code is not reported."""
    return F.sum(F.when(F.col(code) == member, F.col(value)))


def cattle_shares(df: DataFrame, keys: Sequence[str], code: str, value: str, total: str, dairy: str, other: str) -> DataFrame:
    """Dairy / other cows / followers as shares of the herd; the follower residual is clamped at 0."""
    wide = df.groupBy(*keys).agg(
        code_sum(code, value, total).alias("tot"),
        code_sum(code, value, dairy).alias("d"),
        code_sum(code, value, other).alias("o"),
    )
    f = F.greatest(F.col("tot") - F.col("d") - F.col("o"), F.lit(0.0))
    f = F.when(F.col("tot").isNull() | F.col("d").isNull() | F.col("o").isNull(), None).otherwise(f)
    missing = F.col("d").isNull() | F.col("tot").isNull()
    return wide.select(
        *keys,
        F.try_divide("d", "tot").alias("D"),
        F.try_divide("o", "tot").alias("O"),
        F.try_divide(f, F.col("tot")).alias("F"),
        F.when(missing, "MISSING").otherwise("reported").alias("src"),
    )


def small_ruminant_counts(df: DataFrame, keys: Sequence[str], code: str, value: str, codes: dict[str, str]) -> DataFrame:
    """Dairy, meat and follower heads of sheep and goats with the fallbacks for unreported classes.

    ``codes`` names the code of: sheep_total, goat_total, milk_ewes, meat_ewes, all_ewes, she_goats, she_goats_a,
    she_goats_b.  She-goats fall back to the sum of their two classes, meat ewes to all ewes minus milk ewes.
    """
    wide = df.groupBy(*keys).agg(*[code_sum(code, value, c).alias(n) for n, c in codes.items()])
    z = {n: F.coalesce(F.col(n), F.lit(0.0)) for n in codes}
    shegoat = F.when(z["she_goats"] > 0, z["she_goats"]).otherwise(z["she_goats_a"] + z["she_goats_b"])
    residual_ewes = F.greatest(z["all_ewes"] - z["milk_ewes"], F.lit(0.0))
    meat = F.when(z["meat_ewes"] > 0, z["meat_ewes"]).otherwise(residual_ewes)
    dairy = z["milk_ewes"] + shegoat
    tot = z["sheep_total"] + z["goat_total"]
    return wide.select(
        *keys,
        tot.alias("tot"),
        dairy.alias("n_d"),
        meat.alias("n_o"),
        F.greatest(tot - dairy - meat, F.lit(0.0)).alias("n_f"),
    )


def counts_to_shares(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(
        *keys,
        F.try_divide("n_d", "tot").alias("D"),
        F.try_divide("n_o", "tot").alias("O"),
        F.try_divide("n_f", "tot").alias("F"),
        F.when(F.col("tot") > 0, "reported").otherwise("MISSING").alias("src"),
    )


def composition_response(df: DataFrame, region: str, code: str, value: str, total: str, dairy: str, other: str) -> DataFrame:
    """Regional head counts of dairy, other and follower animals; complete regions with a positive total only."""
    wide = df.groupBy(region).agg(
        code_sum(code, value, total).alias("tot"),
        code_sum(code, value, dairy).alias("n_d"),
        code_sum(code, value, other).alias("n_o"),
    )
    wide = wide.where(F.col("n_d").isNotNull() & F.col("n_o").isNotNull() & (F.col("tot") > 0))
    return wide.withColumn("n_f", F.greatest(F.col("tot") - F.col("n_d") - F.col("n_o"), F.lit(0.0))).drop("tot")


def organic_shares(
    organic: DataFrame, totals: DataFrame, geo: str, years: Sequence[int], backcast: tuple[int, float] = (2012, 0.85)
) -> DataFrame:
    """Organic share per (geo, model year) with the temporal rule, from ``(geo, year, value)`` tables.

    Years up to 2000 are 0; years up to 2010 take the backcast year's count times its factor; later years take the same
    year's count when it is reported, else the latest earlier one.  Missing shares are 0.
    """
    base_year, factor = backcast
    y = F.explode(F.array(*[F.lit(v) for v in years])).alias("year")
    targets = totals.select(geo).distinct().select(geo, y)
    # the reported years are a short list: one array that every target row carries along
    reported = organic.agg(F.collect_set("year").alias("_ys")).withColumn("_one", F.lit(1))
    plan = targets.withColumn("_one", F.lit(1)).join(reported, "_one").drop("_one")
    plan = plan.withColumn("as_of", F.array_max(F.filter("_ys", lambda v: v <= F.col("year"))))
    source = F.when(F.col("year") <= 2010, F.lit(base_year)).otherwise(F.col("as_of"))
    plan = plan.withColumn("org_year", source).drop("as_of", "_ys")
    org = organic.groupBy(geo, F.col("year").alias("org_year")).agg(F.sum("value").alias("org"))
    tot = totals.groupBy(geo, "year").agg(F.sum("value").alias("tot"))
    joined = plan.join(org, [geo, "org_year"], "left").join(tot, [geo, "year"], "left")
    scale = F.when(F.col("year") <= 2010, F.lit(factor)).otherwise(F.lit(1.0))
    share = F.when(F.col("year") <= 2000, F.lit(0.0)).otherwise(F.try_divide(F.col("org"), F.col("tot")) * scale)
    src = (
        F.when(F.col("year") <= 2000, F.lit("assumed_0"))
        .when(F.col("year") <= 2010, F.lit(f"{base_year}_backcast"))
        .otherwise(F.concat(F.lit("org_"), F.col("org_year").cast("string")))
    )
    return joined.select(geo, "year", finite_or(share, F.lit(0.0)).alias("organic_share"), src.alias("src"))


def coverage_matrix(
    domain: DataFrame, geo: str, years: Sequence[int], species: Sequence[str], sources: dict[str, DataFrame]
) -> DataFrame:
    """Grid geo × year × species with, per source, its flag (MISSING when absent) and whether it holds a value.

    Each source has columns geo, year, species, src, ok.
    """
    grid = (
        domain.select(geo).distinct()
        .withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))
        .withColumn("species", F.explode(F.array(*[F.lit(s) for s in species])))
    )
    for name, table in sources.items():
        side = table.select(
            geo, "year", "species", F.col("src").alias(f"{name}_src"), F.col("ok").alias(f"{name}_ok")
        )
        grid = grid.join(side, [geo, "year", "species"], "left")
        grid = grid.fillna({f"{name}_src": "MISSING"}).fillna({f"{name}_ok": False})
    return grid


def rollup_region(
    df: DataFrame, code: str, n: int, extensive: Sequence[str], intensive: Sequence[str], weight: str, out: str = "region"
) -> DataFrame:
    """Roll regions up to the first ``n`` code characters: log1p of sums, weighted means of the rest."""
    w = F.coalesce(F.col(weight), F.lit(0.0))
    return df.groupBy(F.substring(F.col(code), 1, n).alias(out)).agg(
        *[F.log1p(F.coalesce(F.sum(c), F.lit(0.0))).alias(f"log1p_{c}") for c in extensive],
        *[weighted_mean(F.col(c), w).alias(c) for c in intensive],
    )


def proxy_response(df: DataFrame, keys: Sequence[str], cls: str, area: str, pattern: str, organic: str) -> DataFrame:
    """Organic and conventional proxy areas from classes matching ``pattern``; regions without any are dropped."""
    hit = F.col(cls).rlike(pattern)
    is_org = F.col(cls).rlike(organic)
    out = df.where(hit).groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(is_org, F.col(area))), F.lit(0.0)).alias("n_org"),
        F.coalesce(F.sum(F.when(~is_org, F.col(area))), F.lit(0.0)).alias("n_conv"),
    )
    return out.where(F.col("n_org") + F.col("n_conv") > 0)


def admin_panel(
    cells: DataFrame,
    areas: DataFrame,
    keys: Sequence[str],
    weight: str,
    intensive: Sequence[str],
    extensive: Sequence[str],
    spread: Sequence[str],
    shares: dict[str, Column],
    cls: str,
    area: str,
    classes: Sequence[str],
) -> DataFrame:
    """Regional panel: weighted means, sums, spreads, threshold shares, total area, and ``lu_area_<class>`` columns.

    All cell measures come from one aggregate; class areas from one conditional aggregate; one join puts them together.
    """
    w = F.col(weight)
    base = cells.groupBy(*keys).agg(
        *[weighted_mean(F.col(c), w).alias(c) for c in intensive],
        *[weighted_sum(F.col(c), w).alias(f"{c}_total") for c in extensive],
        *[weighted_sd(F.col(c), w).alias(f"{c}_sd") for c in spread],
        *[weighted_share(cond, w).alias(n) for n, cond in shares.items()],
        F.sum(w).alias("total_area_km2"),
    )
    lu = areas.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(F.col(cls) == c, F.col(area))), F.lit(0.0)).alias(f"lu_area_{c}") for c in classes]
    )
    return base.join(lu, list(keys), "left").fillna(0.0, [f"lu_area_{c}" for c in classes])


