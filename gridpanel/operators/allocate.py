"""Area-conserving reallocation on long tables: carve-outs, splits, rule cascades, raking, livestock subtypes, anchoring."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpanel.functions.scalar import logistic
from gridpanel.operators.joins import nearest_vintage
from gridpanel.plans.skew import group_quantiles, join_null_safe, with_group_values
from gridpanel.session import cut_lineage


def _among(cls: str, names: Sequence[str]) -> Column:
    """Whether the class is one of ``names``; a null class is none of them."""
    return F.coalesce(F.col(cls).isin(*names), F.lit(False))


# ---- carve-outs ------------------------------------------------------------------------------------------------


def carve_flag(
    df: DataFrame, flags: DataFrame, cell: str, cls: str, area: str, flag: str, pool: Sequence[str], into: str
) -> DataFrame:
    """Move flag × (pool total) of every cell into a new class, taken from the pool in proportion to its members.

    An area already stored under ``into`` is replaced; rows of a null class or cell stay.  The new row of a cell is generated from the cell's first pool
    row, so the table is read once.
    """
    base = df.where(~F.col(cls).eqNullSafe(into)).groupBy(cell, cls).agg(F.sum(area).alias(area))
    base = join_null_safe(base, flags.select(cell, F.col(flag).alias("_f")), [cell], "left")
    in_pool = _among(cls, pool)
    whole = Window.partitionBy(cell)
    total = F.sum(F.when(in_pool, F.col(area)).otherwise(0.0)).over(whole)
    lead = F.row_number().over(whole.orderBy(F.when(in_pool, 0).otherwise(1), cls)) == 1
    base = base.withColumn("_t", total * F.coalesce(F.col("_f"), F.lit(0.0))).withColumn("_lead", lead & in_pool)
    left = F.greatest(
        F.col(area) - F.col("_t") * F.coalesce(F.try_divide(F.col(area), total), F.lit(0.0)), F.lit(0.0)
    )
    base = base.withColumn("_left", F.when(in_pool, left).otherwise(F.col(area)))
    kept = F.struct(F.col(cls).alias("c"), F.col("_left").alias("a"))
    new = F.struct(F.lit(into).alias("c"), F.col("_t").alias("a"))
    rows = F.explode(F.when(F.col("_lead") & (F.col("_t") > 0), F.array(kept, new)).otherwise(F.array(kept)))
    return base.select(cell, rows.alias("_r")).select(cell, F.col("_r.c").alias(cls), F.col("_r.a").alias(area))


def index_weight(year: int, ref: int, index: dict[int, float]) -> float:
    """Ratio of a national index between a year and the reference year, capped at 1; 1 when a year is missing."""
    if year not in index or ref not in index:
        return 1.0
    return min(index[year] / index[ref], 1.0)


def carve_sequential(
    df: DataFrame,
    organic: DataFrame,
    cell: str,
    code: str,
    area: str,
    arable: Sequence[str],
    permanent: Sequence[str],
    pasture: Sequence[str],
    weight: float = 1.0,
    twin: str = "999",
) -> DataFrame:
    """Organic carve-out: primary share, then the mixed share of the rest, then the all-systems share of that rest.

    ``organic`` holds areas cropland, livestock, mixed, all_systems per cell; they become capped shares of the cell's
    pools (arable + permanent, pasture, all three).  Carved area goes to the twin code ``<code>999``.
    """
    base = df.groupBy(cell, code).agg(F.sum(area).alias(area)).join(organic, cell, "left")
    whole = Window.partitionBy(cell)
    is_crop, is_grass = F.col(code).isin(*arable, *permanent), F.col(code).isin(*pasture)

    def pool(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col(area)).otherwise(0.0)).over(whole)

    crop, grass = pool(is_crop), pool(is_grass)

    def capped(col: str, total: Column) -> Column:
        share = F.least(F.coalesce(F.try_divide(F.coalesce(F.col(col), F.lit(0.0)), total), F.lit(0.0)), F.lit(1.0))
        return share * F.lit(weight)

    base = base.withColumns({
        "_pc": capped("cropland", crop), "_pl": capped("livestock", grass),
        "_pm": capped("mixed", crop + grass), "_pa": capped("all_systems", crop + grass),
    })
    a = F.col(area)
    primary = F.when(is_crop, a * F.col("_pc")).when(is_grass, a * F.col("_pl")).otherwise(0.0)
    mixed = F.greatest(a - primary, F.lit(0.0)) * F.col("_pm")
    everything = F.greatest(a - primary - mixed, F.lit(0.0)) * F.col("_pa")
    carved = F.when(is_crop | is_grass, primary + mixed + everything).otherwise(0.0)
    base = base.withColumn("_c", carved)
    kept = F.struct(F.col(code).alias("k"), F.greatest(a - F.col("_c"), F.lit(0.0)).alias("a"))
    moved = F.struct(F.concat(F.col(code).cast("string"), F.lit(twin)).alias("k"), F.col("_c").alias("a"))
    rows = F.explode(F.when(is_crop | is_grass, F.array(kept, moved)).otherwise(F.array(kept)))
    return base.select(cell, rows.alias("_r")).select(cell, F.col("_r.k").alias(code), F.col("_r.a").alias(area))


# ---- splits and rule cascades ----------------------------------------------------------------------------------


def split_by_observed(
    df: DataFrame, typed: DataFrame, cell: str, cls: str, area: str, group: str, type_col: str, residual: dict[str, str]
) -> DataFrame:
    """Split residual classes by observed types of the same cell.

    A cell's residual area A of a group takes its typed areas H scaled by min(1, A / ΣH); what is left stays residual.
    ``residual`` maps a group of ``typed`` to the residual class it refines.
    """
    names = F.create_map(*[F.lit(v) for kv in residual.items() for v in kv])
    obs = typed.where(F.col(area) > 0).withColumn(cls, names[F.col(group)]).where(F.col(cls).isNotNull())
    obs = obs.groupBy(cell, cls, type_col).agg(F.sum(area).alias("_h"))
    obs = obs.groupBy(cell, cls).agg(
        F.sum("_h").alias("_sum"), F.collect_list(F.struct(F.col(type_col).alias("t"), F.col("_h").alias("h"))).alias("_types")
    )
    base = df.groupBy(cell, cls).agg(F.sum(area).alias(area)).join(obs, [cell, cls], "left")
    a, h = F.col(area), F.coalesce(F.col("_sum"), F.lit(0.0))
    scale = F.when(h > 0, F.least(F.lit(1.0), a / F.nullif(h, F.lit(0.0)))).otherwise(F.lit(0.0))
    base = base.withColumn("_scale", scale).withColumn("_rest", F.when(h > 0, F.greatest(a - h, F.lit(0.0))).otherwise(a))
    parts = F.transform(
        F.coalesce(F.col("_types"), F.array().cast("array<struct<t:string,h:double>>")),
        lambda e: F.struct(e["t"].alias("c"), (e["h"] * F.col("_scale")).alias("a")),
    )
    rest = F.array(F.struct(F.col(cls).alias("c"), F.col("_rest").alias("a")))
    rows = F.when(F.col("_types").isNull(), rest).otherwise(F.filter(F.concat(parts, rest), lambda r: r["a"] > 1e-9))
    out = base.select(cell, F.explode(rows).alias("_r"))
    return out.select(cell, F.col("_r.c").alias(cls), F.col("_r.a").alias(area))


def typed_fraction(df: DataFrame, cls: str, area: str, typed: Sequence[str], residual: Sequence[str]) -> DataFrame:
    """Share of the split area that received a type (the gate of the split: too low means the ids do not match)."""
    t = F.sum(F.when(F.col(cls).isin(*typed), F.col(area)).otherwise(0.0))
    r = F.sum(F.when(F.col(cls).isin(*residual), F.col(area)).otherwise(0.0))
    return df.agg(t.alias("typed_area"), r.alias("residual_area"), (t / F.greatest(t + r, F.lit(1e-9))).alias("typed_fraction"))


def check_typed(df: DataFrame, cls: str, area: str, typed: Sequence[str], residual: Sequence[str], min_typed: float = 0.25) -> None:
    got = typed_fraction(df, cls, area, typed, residual).first()["typed_fraction"]
    if got is None or got < min_typed:
        raise ValueError(f"only {100 * (got or 0):.1f}% of the area received a type")


RULE_COLUMNS = ("order", "action", "from_class", "to")


def rules_from_table(table: DataFrame) -> list[dict]:
    """Check a project's rules table and read it in order (a hand-written list: every rule is a step of the plan)."""
    missing = [c for c in RULE_COLUMNS if c not in table.columns]
    if missing:
        raise ValueError(f"rules table lacks columns {missing}")
    rows = table.select(*RULE_COLUMNS).orderBy("order").collect()
    if not rows:
        raise ValueError("the rules table is empty")
    bad = {r["action"] for r in rows} - {"rename", "split"}
    if bad:
        raise ValueError(f"unknown actions {sorted(bad)}")
    return [{"action": r["action"], "from": r["from_class"], "to": r["to"]} for r in rows]


def rule_transitions(classes: DataFrame, rules: Sequence[dict], shares: DataFrame | None) -> DataFrame:
    """Run an ordered rename/split cascade on the distinct (geo, class) pairs.

    A rule is ``{"action": "rename"|"split", "from": class, "to": class or share group}``.  The geo of a split falls back
    from exact to its first two characters to the group's mean composition (plain mean, renormalised).  The result
    ``(geo, class, target, factor)`` is as small as geos × classes, so the cell table is joined once whatever the number
    of rules.
    """
    state = classes.select("geo", "class").distinct().withColumn("target", F.col("class")).withColumn("factor", F.lit(1.0))
    for rule in rules:
        hit = F.col("target").eqNullSafe(rule["from"])
        if rule["action"] == "rename":
            state = state.withColumn("target", F.when(hit, F.lit(rule["to"])).otherwise(F.col("target")))
            continue
        if rule["action"] != "split":
            raise ValueError(f"unknown action {rule['action']!r}")
        if shares is None:
            raise ValueError("split rules need a share table")
        table = shares.where(F.col("group") == rule["to"])
        part = F.struct(F.col("target").alias("t"), F.col("share").alias("s"))
        by_geo = table.groupBy("geo").agg(F.collect_list(part).alias("_p"))
        mean = table.groupBy("target").agg(F.avg("share").alias("share"))
        mean = mean.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy()))
        mean = mean.agg(F.collect_list(part).alias("_pm")).withColumn("_one", F.lit(1))
        exact = by_geo.select("geo", F.col("_p").alias("_pe"))
        coarse = by_geo.select(F.col("geo").alias("_g2"), F.col("_p").alias("_pc"))
        state = (
            state.join(exact, "geo", "left")
            .join(coarse, F.substring("geo", 1, 2) == F.col("_g2"), "left")
            .withColumn("_one", F.lit(1)).join(mean, "_one", "left")
        )
        same = F.array(F.struct(F.col("target").alias("t"), F.lit(1.0).alias("s")))
        found = F.coalesce("_pe", "_pc", F.when(F.size("_pm") > 0, F.col("_pm")))
        total = F.aggregate(found, F.lit(0.0), lambda a, x: a + x["s"])
        checked = (
            F.when(found.isNull(), F.raise_error(F.lit(f"no shares for group {rule['to']}")))
            .when(F.abs(total - 1) > 1e-6, F.raise_error(F.lit(f"the shares of group {rule['to']} do not sum to 1")))
            .otherwise(found)
        )
        parts = F.when(hit, checked).otherwise(same)
        state = state.select("geo", "class", "factor", F.explode(parts).alias("_x")).select(
            "geo", "class", F.col("_x.t").alias("target"), (F.col("factor") * F.col("_x.s")).alias("factor")
        )
    return state.groupBy("geo", "class", "target").agg(F.sum("factor").alias("factor"))


def apply_class_rules(
    df: DataFrame, rules: Sequence[dict], shares: DataFrame | None, geo: DataFrame, cell: str, cls: str, area: str
) -> DataFrame:
    """Apply a rename/split cascade to cell areas; area is conserved because the factors of a class sum to 1.

    Rows of a null class pass through, and so do those of a null cell, which has no geo.
    """
    sums = df.groupBy(cell, cls).agg(F.sum(area).alias(area))
    placed = sums.join(geo.select(cell, F.coalesce(F.col("geo"), F.lit("")).alias("geo")), cell, "left").fillna("", ["geo"])
    pairs = placed.select("geo", F.col(cls).alias("class"))
    moves = rule_transitions(pairs, rules, shares).withColumnRenamed("class", cls)
    out = join_null_safe(placed, moves, ["geo", cls]).select(cell, F.col("target").alias(cls), (F.col(area) * F.col("factor")).alias(area))
    return out.groupBy(cell, cls).agg(F.sum(area).alias(area))


# ---- raking ----------------------------------------------------------------------------------------------------


def zone_flows(obs: DataFrame, targets: DataFrame, zone: str, cls: str, area: str) -> DataFrame:
    """Zone-level transition shares that turn the observed class totals into the scaled targets.

    Targets are scaled to the observed zone total.  A surplus class keeps its target and sends the rest to the deficit
    classes in proportion to their deficit.  All tables here have one row per zone and class (or class pair).
    """
    o = obs.groupBy(zone, cls).agg(F.sum(area).alias("obs"))
    t = targets.groupBy(zone, cls).agg(F.sum(area).alias("tgt"))
    z = o.unionByName(t, allowMissingColumns=True).groupBy(zone, cls).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("obs", "tgt")])
    z = with_group_values(z, [zone], _to=F.sum("obs"), _tt=F.sum("tgt")).where(F.col("_to") > 0)
    goal = F.when(F.col("_tt") > 0, F.col("tgt") * F.col("_to") / F.nullif(F.col("_tt"), F.lit(0.0))).otherwise(F.col("obs"))
    z = z.withColumn("tgt_s", goal)
    z = z.withColumn("surplus", F.greatest(F.col("obs") - F.col("tgt_s"), F.lit(0.0)))
    z = z.withColumn("deficit", F.greatest(F.col("tgt_s") - F.col("obs"), F.lit(0.0)))
    z = with_group_values(z, [zone], _d=F.sum("deficit"))
    stay = z.select(zone, F.col(cls).alias("from_class"), F.col(cls).alias("to_class"), (F.col("obs") - F.col("surplus")).alias("value"))
    give = z.where(F.col("surplus") > 0).select(zone, F.col(cls).alias("from_class"), "surplus")
    take = z.where((F.col("deficit") > 0) & (F.col("_d") > 0)).select(
        zone, F.col(cls).alias("to_class"), (F.col("deficit") / F.col("_d")).alias("_part")
    )
    move = join_null_safe(give, take, [zone]).select(zone, "from_class", "to_class", (F.col("surplus") * F.col("_part")).alias("value"))
    flows = stay.unionByName(move).where(F.col("value") > 0)
    total = F.sum("value").over(Window.partitionBy(zone, "from_class"))
    return flows.withColumn("share", F.col("value") / total)


def rake_to_targets(
    obs: DataFrame, targets: DataFrame, classes: Sequence[str], pixel: str, zone: str, cls: str, area: str
) -> DataFrame:
    """Rake pixel areas to zone targets for the named classes; pixel totals stay, other classes pass through.

    Pixels without a zone are a zone of their own: without targets for it they keep their areas. Rows of a null class pass through.
    """
    inside = _among(cls, classes)
    work = obs.where(inside)
    flows = zone_flows(work, targets.where(inside), zone, cls, area).select(zone, F.col("from_class").alias(cls), "to_class", "share")
    pix = work.groupBy(pixel, zone, cls).agg(F.sum(area).alias(area))
    raked = join_null_safe(pix, flows, [zone, cls]).select(
        pixel, zone, F.col("to_class").alias(cls), (F.col(area) * F.col("share")).alias(area)
    )
    raked = raked.groupBy(pixel, zone, cls).agg(F.sum(area).alias(area))
    return obs.where(~inside).select(pixel, zone, cls, area).unionByName(raked)


# ---- livestock subtypes ----------------------------------------------------------------------------------------


def allocate_subtypes(
    totals: DataFrame, production: DataFrame, dairy: DataFrame, organic: DataFrame, country: str, region: str, keys: Sequence[str]
) -> DataFrame:
    """Split totals into dairy/other/follower × organic/conventional.

    The regional dairy share replaces the country's when present; the remainder splits by the country's O:F ratio.
    ``production`` has D, O, F per (country, keys); ``dairy`` dairy_share per (region, keys); ``organic``
    organic_share per (country, keys). Null keys meet. A unit without any dairy share is an error: shares are resolved before heads are split, and heads
    must not get lost here. Without an O:F ratio the remainder splits evenly; without an organic share all is conventional.
    """
    joined = join_null_safe(totals, production, [country, *keys], "left")
    joined = join_null_safe(joined, dairy, [region, *keys], "left")
    joined = join_null_safe(joined, organic, [country, *keys], "left")
    unit = F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in dict.fromkeys([country, region, *keys])])
    missing = F.raise_error(F.concat(F.lit("no production shares for "), unit)).cast("double")
    d = F.coalesce(F.col("dairy_share"), F.col("D"), missing)
    of = F.col("O") + F.col("F")
    o = (F.lit(1.0) - d) * F.coalesce(F.try_divide(F.col("O"), of), F.lit(0.5))
    f = (F.lit(1.0) - d) - o
    org = F.coalesce(F.col("organic_share"), F.lit(0.0))
    cells = [
        F.struct(F.lit(t).alias("subtype"), F.lit(s).alias("system"), (F.col("total") * share * part).alias("heads"))
        for t, share in (("D", d), ("O", o), ("F", f))
        for s, part in (("organic", org), ("conventional", F.lit(1.0) - org))
    ]
    return joined.select(*totals.columns, F.explode(F.array(*cells)).alias("_c")).select(*totals.columns, "_c.*")


def resolve_share(domain: DataFrame, shares: DataFrame, geo: str, year: str, cluster: str, cols: Sequence[str], window: int = 2) -> DataFrame:
    """Fallback ladder for share vectors: exact, nearest year within ``window``, cluster mean, overall mean.

    Returns the resolved vector (renormalised), the rung and the pool size.  ``domain`` has geo, year and cluster;
    ``shares`` has geo, year, cluster and the share columns.
    """
    vec = [F.col(c) for c in cols]
    ok = shares.where(F.greatest(*[c.isNull().cast("int") for c in vec]) == 0)
    near = nearest_vintage(domain.select(geo, year, cluster), ok.select(geo, F.col(year).alias("y"), *cols), [geo], year, "y", cols)
    gap = F.abs(F.col("matched_y") - F.col(year))
    pool = ok.groupBy(cluster, year).agg(*[F.avg(c).alias(f"c_{c}") for c in cols], F.count(F.lit(1)).alias("c_n"))
    allm = ok.groupBy(year).agg(*[F.avg(c).alias(f"a_{c}") for c in cols], F.count(F.lit(1)).alias("a_n"))
    out = near.join(pool, [cluster, year], "left").join(allm, [year], "left")
    rung = (
        F.when(gap == 0, "exact").when(gap <= window, "nearest_year").when(F.col("c_n") > 0, "cluster")
        .when(F.col("a_n") > 0, "overall").otherwise("unresolved")
    )
    n_pool = F.when(gap <= window, F.lit(1)).when(F.col("c_n") > 0, F.col("c_n")).otherwise(F.col("a_n")).cast("long")
    picked = {c: F.when(gap <= window, F.col(c)).otherwise(F.coalesce(F.col(f"c_{c}"), F.col(f"a_{c}"))) for c in cols}
    total = sum((p for p in picked.values()), F.lit(0.0))
    final = [F.try_divide(p, total).alias(c) for c, p in picked.items()]
    return out.select(geo, year, cluster, *final, rung.alias("rung"), n_pool.alias("n_pool"))


def allocate_by_weights(
    x: DataFrame, gamma: DataFrame, totals: DataFrame, unit: str, country: str, driver: str, cell: str, within: Sequence[str]
) -> DataFrame:
    """Heads = total × exp(γ·x) / Σ exp(γ·x), normalised inside ``within``.

    ``x`` is long (unit, country, driver, value) and may carry the ``within`` columns; ``gamma`` is
    (country, cell, driver, gamma); ``totals`` holds ``total`` per ``within``. Null keys meet. A country without any coefficient, and a total without a
    unit, are errors: their heads would get lost.
    """
    ids = list(dict.fromkeys([unit, country, *[w for w in within if w not in (unit, country)]]))
    joined = join_null_safe(x, gamma, [country, driver], "left")
    score = joined.groupBy(*ids, cell).agg(F.sum(F.col("value") * F.col("gamma")).alias("_u"), F.count("gamma").alias("_c"))
    score = with_group_values(score, ids, _known=F.sum("_c")).where((F.col("_c") > 0) | (F.col("_known") == 0))
    lost = F.raise_error(F.concat(F.lit("no coefficients for country "), F.coalesce(F.col(country).cast("string"), F.lit("null")))).cast("double")
    score = score.withColumn("_u", F.when(F.col("_known") == 0, lost).otherwise(F.col("_u")))
    score = with_group_values(score, within, _mx=F.max("_u"))
    score = score.withColumn("_e", F.exp(F.col("_u") - F.col("_mx")))
    score = with_group_values(score, within, _se=F.sum("_e"))
    out = join_null_safe(score, totals.select(*within, "total"), list(within), "right")
    idle = F.raise_error(F.lit("a total has no unit with coefficients")).cast("double")
    weight = F.coalesce(F.col("_e") / F.col("_se"), idle)
    return out.select(*ids, cell, weight.alias("weight"), (F.col("total") * weight).alias("heads"))


# ---- coefficients ----------------------------------------------------------------------------------------------


def total_driver_name(col: Column) -> Column:
    """Name of a composition driver in the totals design: areas and exposure variables carry a log1p_ prefix there."""
    skewed = col.startswith("lu_area_") | col.isin("GDP", "Pop", "allPA_area")
    return F.when(skewed, F.concat(F.lit("log1p_"), col)).otherwise(col)


def merge_coefficients(beta: DataFrame, delta: DataFrame, organic: DataFrame, anchor: DataFrame) -> DataFrame:
    """γ = β(country, driver) + δ(subtype, driver) ± δ_org(driver), the intercept also ± anchor / 2.

    ``beta``: species, country, driver, beta_total.  ``delta``: species, subtype, driver, delta.  ``organic``: driver,
    delta_org.  ``anchor``: species, country, anchor.  Drivers of δ absent from β are left out, missing ones count 0.
    """
    subtypes = delta.select("species", "subtype").distinct()
    d = delta.select("species", "subtype", total_driver_name(F.col("driver")).alias("driver"), F.col("delta").alias("delta_dof"))
    o = organic.select(total_driver_name(F.col("driver")).alias("driver"), F.col("delta_org").alias("_o"))
    base = beta.join(subtypes, "species").join(d, ["species", "subtype", "driver"], "left").join(o, "driver", "left")
    base = base.join(anchor, ["species", "country"], "left").fillna(0.0, ["delta_dof", "_o", "anchor"])
    systems = F.explode(F.array(F.lit("conventional"), F.lit("organic")))
    base = base.withColumn("system", systems)
    shift = F.col("_o") + F.when(F.col("driver") == "intercept", F.col("anchor") / 2).otherwise(0.0)
    signed = F.when(F.col("system") == "organic", shift).otherwise(-shift)
    return base.withColumn("delta_org", signed).select(
        "species", "country", "subtype", "system", "driver", "beta_total", "delta_dof", "delta_org",
        (F.col("beta_total") + F.col("delta_dof") + F.col("delta_org")).alias("gamma"),
    )


def driver_overlap(beta: DataFrame, delta: DataFrame) -> DataFrame:
    """Share of δ drivers found in the totals design per species; below one half the two speak different class schemes."""
    known = beta.select("species", "driver").distinct().withColumn("_in", F.lit(1))
    d = delta.select("species", total_driver_name(F.col("driver")).alias("driver")).distinct()
    out = d.join(known, ["species", "driver"], "left").groupBy("species").agg(
        F.count(F.lit(1)).alias("n_drivers"), F.count("_in").alias("n_matched")
    )
    return out.withColumn("weak", F.col("n_matched") < F.col("n_drivers") * 0.5)


def anchor_level(
    df: DataFrame, targets: DataFrame, keys: Sequence[str], eta: str, weight: str, target: str, bound: float = 40.0, points: int = 16
) -> DataFrame:
    """Level shift c per key with Σ w·plogis(η + c) / Σ w equal to the target (clipped to [1e-4, 1 − 1e-4]).

    Each round evaluates ``points`` shifts of every key in one aggregation pass and keeps the interval that brackets the
    target, so ten rounds reach 1e-10.  Only the small interval table passes from round to round.
    """
    ks = list(keys)
    goal = F.greatest(F.least(F.col(target), F.lit(1 - 1e-4)), F.lit(1e-4))
    state = targets.where(F.col(target).isNotNull()).select(*ks, goal.alias("_goal"), F.lit(-bound).alias("_lo"), F.lit(bound).alias("_hi"))
    data = df.select(*ks, F.col(eta).alias("_eta"), F.col(weight).alias("_w"))
    for _ in range(10):
        step = (F.col("_hi") - F.col("_lo")) / (points + 1)
        grid = [F.col("_lo") + step * i for i in range(1, points + 1)]
        joined = data.join(state, ks)
        level = [F.sum(F.col("_w") * logistic(F.col("_eta") + g)).alias(f"_s{i}") for i, g in enumerate(grid)]
        sums = joined.groupBy(*ks, "_goal", "_lo", "_hi").agg(F.sum("_w").alias("_sw"), *level)
        below = sum((F.when(F.col(f"_s{i}") < F.col("_goal") * F.col("_sw"), 1).otherwise(0) for i in range(points)), F.lit(0))
        sums = sums.withColumn("_k", below).withColumn("_step", step)
        state = cut_lineage(sums.select(
            *ks, "_goal", (F.col("_lo") + F.col("_step") * F.col("_k")).alias("_lo"),
            (F.col("_lo") + F.col("_step") * (F.col("_k") + 1)).alias("_hi"),
        ))
    return state.select(*ks, F.col("_goal").alias(target), ((F.col("_lo") + F.col("_hi")) / 2).alias("anchor"))


# ---- responses -------------------------------------------------------------------------------------------------


def proportions(df: DataFrame, keys: Sequence[str], cls: str, area: str, floor: float = 1e-6) -> DataFrame:
    """Class proportions of each key with the largest class (overall) dropped as reference."""
    sums = df.groupBy(*keys, cls).agg(F.sum(area).alias("_a"))
    ref = sums.groupBy(cls).agg(F.sum("_a").alias("_t")).orderBy(F.desc("_t"), F.asc(cls)).limit(1).select(cls)
    total = F.sum("_a").over(Window.partitionBy(*keys))
    props = sums.withColumn("prop", F.col("_a") / F.greatest(total, F.lit(floor)))
    return props.join(ref, cls, "left_anti").select(*keys, cls, "prop")


def log_offset(area: Column, floor: float = 1e-4) -> Column:
    return F.log(F.greatest(area, F.lit(floor)))


def to_pseudocounts(df: DataFrame, keys: Sequence[str], cls: str, value: str, level: float = 1000.0) -> DataFrame:
    """Scale rows so that the median row total is ``level``, round, and drop rows that round to nothing."""
    clean = df.withColumn(value, F.greatest(F.col(value), F.lit(0.0)))
    totals = clean.groupBy(*keys).agg(F.sum(value).alias("_t"))
    median = group_quantiles(totals, [], "_t", {"_med": 0.5}).withColumn("_one", F.lit(1))
    scaled = clean.withColumn("_one", F.lit(1)).join(median, "_one")
    scaled = scaled.withColumn("count", F.bround(F.col(value) * F.lit(level) / F.col("_med"), 0)).drop("_one", "_med")
    alive = scaled.groupBy(*keys).agg(F.sum("count").alias("_c")).where(F.col("_c") > 0).select(*keys)
    return scaled.join(alive, list(keys), "left_semi")


def stabilise(df: DataFrame, keys: Sequence[str], cls: str, share: str, eps: float) -> DataFrame:
    """Add ε · (1 − sparsity of the class) to every share and renormalise rows; needs a zero-filled table."""
    sparsity = df.groupBy(cls).agg(F.avg((F.col(share) == 0).cast("double")).alias("_z"))
    lifted = df.join(sparsity, cls).withColumn("_s", F.col(share) + F.lit(eps) * (1 - F.col("_z")))
    total = F.sum("_s").over(Window.partitionBy(*keys))
    return lifted.withColumn(share, F.col("_s") / total).drop("_s", "_z")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _dirichlet(alpha: pd.Series, seed: pd.Series) -> pd.Series:
    def one(a, s):
        g = np.random.default_rng(int(s)).gamma(np.maximum(np.asarray(a, dtype=float), 1e-12))
        return (g / g.sum()).tolist() if g.sum() > 0 else [1.0 / len(g)] * len(g)

    return pd.Series([one(a, s) for a, s in zip(alpha, seed)])


def sample_shares(df: DataFrame, keys: Sequence[str], counts: Sequence[str], draws: int, seed: int, floor: float = 0.5) -> DataFrame:
    """Dirichlet draws of a share vector per key (two counts give a Beta); the seed is a hash of key and draw."""
    alpha = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) + F.lit(floor) for c in counts])
    base = df.select(*keys, alpha.alias("_a")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    base = base.withColumn("_seed", F.pmod(F.xxhash64(F.lit(seed), *keys, "draw"), F.lit(2**31 - 1)))
    base = base.withColumn("_s", _dirichlet("_a", "_seed"))
    return base.select(*keys, "draw", *[F.col("_s")[i].alias(c) for i, c in enumerate(counts)])


