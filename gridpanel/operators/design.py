"""Design assembly: recipes, group means, scaling, alternative-specific blocks, nest trees and node shares."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.functions.scalar import apply_transforms, finite_or
from gridpanel.operators.focal import focal_columns
from gridpanel.plans.skew import group_quantiles, with_group_values


# ---- recipes ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Recipe:
    """Everything a prediction needs to rebuild a design column by column."""

    key: list[str]
    features: list[str]
    classes: list[str]
    lattice: tuple[str, str]
    slices: list[str]
    group: str
    group_levels: list[str]
    transforms: list[dict] = field(default_factory=list)
    add_nodata: bool = False

    @property
    def focal_columns(self) -> list[str]:
        return [f"focal_{c}" for c in self.classes] + (["focal_NODATA"] if self.add_nodata else [])

    @property
    def col_order(self) -> list[str]:
        return ["intercept", *self.features, *self.focal_columns]

    def to_dict(self) -> dict:
        return asdict(self)


def build_recipe(df: DataFrame, **spec) -> tuple[DataFrame, Recipe]:
    """Learn the group levels of a wide cell table (one column per class area) and return design and recipe."""
    levels = sorted(str(r[0]) for r in df.select(spec["group"]).distinct().collect())
    recipe = Recipe(group_levels=levels, **spec)
    return apply_recipe(recipe, df), recipe


def apply_recipe(recipe: Recipe, df: DataFrame) -> DataFrame:
    """Replay a recipe: focal columns from the class areas, transforms, intercept, non-finite → 0, stored order.

    A group outside the fitted levels becomes NULL in ``group_known`` and falls back to pooled coefficients.
    """
    ix, iy = recipe.lattice
    cells = df.drop(*[c for c in df.columns if c.startswith("focal_")])
    keys = [*recipe.slices, ix, iy]
    wide = focal_columns(cells, recipe.slices, ix, iy, recipe.classes, recipe.add_nodata)
    out = apply_transforms(wide, recipe.transforms).withColumn("intercept", F.lit(1.0))
    known = F.when(F.col(recipe.group).isin(*recipe.group_levels), F.col(recipe.group))
    return out.select(
        *dict.fromkeys([*recipe.key, *keys]),
        known.alias("group_known"),
        *[finite_or(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in recipe.col_order],
    )


def recipe_check(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Largest absolute drift of plain columns; largest, mean and p99 drift of focal columns; share above 0.01."""
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols])
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols])
    both = left.join(right, list(keys))
    diffs = F.array(*[
        F.struct(F.lit(c.startswith("focal_")).alias("focal"), F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")).alias("d")) for c in cols
    ])
    long = both.select(F.explode(diffs).alias("r")).select("r.*")
    stats = long.groupBy("focal").agg(
        F.max("d").alias("max_d"), F.avg("d").alias("mean_d"), F.avg((F.col("d") > 0.01).cast("double")).alias("frac_gt01")
    )
    return stats.join(group_quantiles(long, ["focal"], "d", {"p99_d": 0.99}), "focal")


def apply_count_recipe(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], transforms: Sequence[dict], time_col: str,
    year_dummies: Sequence[int], offset_col: str, offset_floor: float, add_time: bool = False,
) -> DataFrame:
    """Count design: log1p columns, year dummies, optional time column, log offset with a floor."""
    out = apply_transforms(df, transforms)
    dummies = {f"year_{y}": (F.col(time_col) == y).cast("double") for y in year_dummies}
    out = out.withColumns({**dummies, "intercept": F.lit(1.0), "time": F.col(time_col).cast("double")})
    order = ["intercept", *(["time"] if add_time else []), *features, *dummies]
    offset = F.log(F.greatest(F.col(offset_col).cast("double"), F.lit(offset_floor)))
    return out.select(
        *keys, *[finite_or(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in order], offset.alias("offset")
    )


# ---- group means -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class GroupMeanDesign:
    """Scaled group means (one row per group) and the columns they generate."""

    table: DataFrame
    group: str
    mean_cols: list[str]
    re_cols: list[str]
    prefix: str

    @property
    def names(self) -> list[str]:
        return [self.name(r, m) for r in self.re_cols for m in self.mean_cols]

    def name(self, re_col: str, mean_col: str) -> str:
        return f"{self.prefix}_{mean_col}" if re_col == "intercept" else f"{self.prefix}_{re_col}_x_{mean_col}"


def group_mean_design(
    df: DataFrame, group: str, mean_cols: Sequence[str], re_cols: Sequence[str] = ("intercept",),
    center: bool = True, scale: bool = True, prefix: str = "GM",
) -> GroupMeanDesign:
    """Group means, centred and scaled across groups; means without variation between groups are dropped."""
    means = df.groupBy(group).agg(*[F.avg(c).alias(c) for c in mean_cols])
    stats = means.agg(
        *[F.avg(c).alias(f"m_{c}") for c in mean_cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in mean_cols]
    ).first()
    keep = [c for c in mean_cols if (stats[f"s_{c}"] or 0.0) > 1e-10]
    if not keep:
        raise ValueError("no usable group-mean columns")
    scaled = means.select(group, *[
        ((F.col(c) - (stats[f"m_{c}"] if center else 0.0)) / (max(stats[f"s_{c}"], 1e-12) if scale else 1.0)).alias(f"_x_{c}")
        for c in keep
    ])
    return GroupMeanDesign(scaled, group, keep, list(re_cols), prefix)


def apply_group_mean_design(design: GroupMeanDesign, df: DataFrame) -> DataFrame:
    """Add the stored columns to new rows; a group that was not there at fit time fails the job."""
    clash = [n for n in design.names if n in df.columns]
    if clash:
        raise ValueError(f"columns already present: {clash}")
    out = df.join(design.table, design.group, "left")
    unseen = F.raise_error(F.concat(F.lit("group not seen at fit time: "), F.col(design.group).cast("string"))).cast("double")
    added = {}
    for r in design.re_cols:
        base = F.lit(1.0) if r == "intercept" else F.col(r)
        for m in design.mean_cols:
            x = F.col(f"_x_{m}")
            added[design.name(r, m)] = base * F.when(x.isNull(), unseen).otherwise(x)
    return out.withColumns(added).drop(*[f"_x_{m}" for m in design.mean_cols])


# ---- contrasts and scaling -------------------------------------------------------------------------------------


def level_contrast(df: DataFrame, cols: Sequence[str], low: str, high: str, stem: str) -> DataFrame:
    """Replace collinear indices by their mean level and the high − low response."""
    n = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    return df.withColumns({
        f"{stem}_level": F.try_divide(total, n.cast("double")), f"{stem}_response": F.col(high) - F.col(low)
    }).drop(*cols)


def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long table per column: mean, sd, largest absolute value, whether more than two values occur."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [
            F.struct(
                F.lit(c).alias("cov"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.max(F.abs(x)).alias("max_abs"),
                # more than two values: something strictly between the extremes
                F.min(x).alias("lo"), F.max(x).alias("hi"),
            ).alias(f"_{c}")
        ]
    return df.agg(*aggs).select(F.explode(F.array(*[F.col(f"_{c}") for c in cols])).alias("r")).select("r.*")


def display_sds(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Display scale: sd for unbounded covariates, 1 for bounded ones, shares, ``focal_``/``prev_`` and the intercept."""
    per_unit = F.col("cov").rlike(r"^focal_|^prev_|_share$") | (F.col("cov") == "intercept")
    usable = (F.col("max_abs") > 1) & F.col("sd").isNotNull() & (F.col("sd") > 0)
    scale = F.when(~per_unit & usable, F.col("sd")).otherwise(F.lit(1.0))
    return column_stats(df, cols).select("cov", scale.alias("sd_x"))


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Z-score continuous columns (largest absolute value above 1, more than two values); others stay."""
    with_range = with_group_values(
        df, [],
        **{f"_m_{c}": F.avg(c) for c in cols}, **{f"_s_{c}": F.stddev_samp(c) for c in cols},
        **{f"_a_{c}": F.max(F.abs(F.col(c))) for c in cols},
        **{f"_d_{c}": F.approx_count_distinct(c) for c in cols},
    )
    out = with_range.withColumns({
        c: F.when(
            (F.col(f"_a_{c}") > 1) & (F.col(f"_d_{c}") > 2), F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}"))
        ).otherwise(F.col(c).cast("double"))
        for c in cols
    })
    return out.drop(*[f"_{p}_{c}" for p in "msad" for c in cols])


def add_coordinates(df: DataFrame, x: str, y: str) -> DataFrame:
    """Z-scored coordinate columns ``coord_x`` and ``coord_y``."""
    df = with_group_values(df, [], _mx=F.avg(x), _sx=F.stddev_samp(x), _my=F.avg(y), _sy=F.stddev_samp(y))
    return df.withColumns({
        "coord_x": F.try_divide(F.col(x) - F.col("_mx"), F.col("_sx")),
        "coord_y": F.try_divide(F.col(y) - F.col("_my"), F.col("_sy")),
    }).drop("_mx", "_sx", "_my", "_sy")


def empirical_log_odds(df: DataFrame, cls: str, value: str, baseline: str | None = None) -> DataFrame:
    """log((total + 1) / (baseline total + 1)) per class; the baseline defaults to the largest class."""
    sums = df.groupBy(cls).agg((F.sum(value) + 1.0).alias("smoothed"))
    everything = Window.partitionBy()  # one row per class
    if baseline is None:
        top = F.max_by(F.col("smoothed"), F.col("smoothed")).over(everything)
    else:
        top = F.max(F.when(F.col(cls) == baseline, F.col("smoothed"))).over(everything)
    return sums.select(cls, "smoothed", F.log(F.col("smoothed") / top).alias("log_odds"))


# ---- alternative-specific blocks -------------------------------------------------------------------------------


def alt_values(df: DataFrame, keys: Sequence[str], mapping: DataFrame, col: str, value: str, x: str | None = None) -> DataFrame:
    """Sum mapped columns to alternatives, renormalise the row, then multiply by an interaction column.

    ``df`` is long (keys, column, value [, x]); ``mapping`` is (column, alternative), one row per design column.  Every
    alternative appears for every row.  The interaction comes after renormalising, so it is not divided away.
    """
    names = mapping.select("alternative").distinct()
    alts = names.agg(F.array_sort(F.collect_set("alternative")).alias("_alts")).withColumn("_one", F.lit(1))
    rows = df.groupBy(*keys).agg(*([F.first(x).alias("_x")] if x else [F.lit(1.0).alias("_x")]))
    grid = rows.withColumn("_one", F.lit(1)).join(alts, "_one").select(*keys, "_x", F.explode("_alts").alias("alternative"))
    sums = df.join(mapping, col).groupBy(*keys, "alternative").agg(F.sum(value).alias("_z"))
    out = grid.join(sums, [*keys, "alternative"], "left").fillna(0.0, ["_z"])
    total = F.sum("_z").over(Window.partitionBy(*keys))
    share = F.when(total > 0, F.col("_z") / F.greatest(total, F.lit(1e-12))).otherwise(F.lit(0.0))
    return out.select(*keys, "alternative", (share * F.col("_x")).alias("z"))


def alt_scale(z: DataFrame, coef: str = "shared") -> DataFrame:
    """Scale to store: one sd over all values (shared) or one per alternative; degenerate → 1."""
    by = [] if coef == "shared" else ["alternative"]
    out = z.groupBy(*by).agg(F.stddev_samp("z").alias("_s"))
    good = F.col("_s").isNotNull() & ~F.isnan("_s") & (F.col("_s") > 0)
    return out.select(*by, F.when(good, F.col("_s")).otherwise(F.lit(1.0)).alias("z_scale"))


def alt_apply_scale(z: DataFrame, scale: DataFrame) -> DataFrame:
    """Divide by the stored scale (fit and prediction use the same table)."""
    if "alternative" in scale.columns:
        out = z.join(scale, "alternative")
    else:
        out = z.withColumn("_one", F.lit(1)).join(scale.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return out.withColumn("z", F.col("z") / F.col("z_scale")).drop("z_scale")


# ---- nest trees ------------------------------------------------------------------------------------------------

Paths = dict[str, list[str]]


def paths_by_prefix(classes: Sequence[str], sep: str = "_", subsplit: Sequence[str] = (), flat: Sequence[str] = ()) -> Paths:
    """First token as nest (second token below it for ``subsplit`` groups); lone classes sit at the root."""
    first = {c: c.split(sep)[0] for c in classes}
    out: Paths = {}
    for c in classes:
        group, parts = first[c], c.split(sep)
        if c in flat or sum(f == group for f in first.values()) == 1:
            out[c] = []
        elif group in subsplit and len(parts) >= 2:
            out[c] = [group, sep.join(parts[:2])]
        else:
            out[c] = [group]
    return out


def paths_auto(classes: Sequence[str], sep: str = "_", max_depth: int = 6, flat: Sequence[str] = ()) -> Paths:
    """Recursive grouping on leading tokens; a level that does not split its members is skipped."""
    out: Paths = {c: [] for c in classes}
    todo = [([c for c in classes if c not in flat], 1, [])]
    while todo:
        members, depth, above = todo.pop()
        groups: dict[str, list[str]] = {}
        settled = []
        for m in members:
            parts = m.split(sep)
            if len(members) > 1 and depth <= max_depth and len(parts) >= depth:
                groups.setdefault(sep.join(parts[:depth]), []).append(m)
            else:
                settled.append(m)
        for m in settled:
            out[m] = list(above)
        if len(groups) == 1 and not settled:
            todo.append((next(iter(groups.values())), depth + 1, above))
            continue
        for name, inside in groups.items():
            if len(inside) == 1:
                out[inside[0]] = list(above)
            else:
                todo.append((inside, depth + 1, [*above, name]))
    return out


def split_nest(paths: Paths, nest: str, labels: tuple[str, str], second: Callable[[str], bool], min_each: int = 1) -> Paths:
    """Divide the classes directly under a nest in two when both sides have enough members."""
    inside = [c for c, p in paths.items() if p and p[-1] == nest]
    b = [c for c in inside if second(c)]
    a = [c for c in inside if c not in b]
    if len(a) < min_each or len(b) < min_each:
        return paths
    return {c: ([*p, f"{nest}/{labels[0]}"] if c in a else [*p, f"{nest}/{labels[1]}"] if c in b else p) for c, p in paths.items()}


def _organic(classes: Sequence[str]) -> Paths:
    paths = paths_by_prefix(classes)
    for nest in ("Cropland", "Pasture"):
        paths = split_nest(paths, nest, ("conventional", "organic"), lambda c: c.endswith("O"))
    return paths


def _permanent_crops(paths: Paths) -> Paths:
    for nest in ("Cropland", "Cropland/conventional", "Cropland/organic"):
        paths = split_nest(paths, nest, ("arable", "permanent"), lambda c: c in ("Cropland_other", "Cropland_other_O"), 2)
    return paths


# Registry of curated schemes: builders from a class list to paths.
SCHEMES: dict[str, Callable[[Sequence[str]], Paths]] = {
    "AUTO": paths_auto,
    "PREFIX": paths_by_prefix,
    "PREFIX_ORGANIC": _organic,
    "PREFIX_CROP": lambda cs: _permanent_crops(paths_by_prefix(cs)),
    "PREFIX_CROP_ORGANIC": lambda cs: _permanent_crops(_organic(cs)),
    "PREFIX_CROPLAND_SUBSPLIT": lambda cs: paths_by_prefix(cs, subsplit=("Cropland",)),
}


def register_scheme(name: str, builder: Callable[[Sequence[str]], Paths]) -> None:
    SCHEMES[name.upper()] = builder


def nest_paths(classes: Sequence[str], scheme: str) -> Paths:
    if scheme.upper() not in SCHEMES:
        raise ValueError(f"unknown scheme {scheme!r}; have {sorted(SCHEMES)}")
    paths = SCHEMES[scheme.upper()](classes)
    check_paths(paths, classes)
    return paths


def paths_from_mapping(mapping: DataFrame, cls: str, levels: Sequence[str]) -> DataFrame:
    """Paths table from mapping columns: non-blank levels from the root down; conflicting rows of a class are an error."""
    parts = F.filter(F.array(*[F.trim(F.coalesce(F.col(c), F.lit(""))) for c in levels]), lambda v: v != "")
    distinct = mapping.select(F.col(cls).alias("class"), parts.alias("path")).distinct()
    n = distinct.groupBy("class").agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("path"))
    clash = F.raise_error(F.concat(F.lit("class on two paths: "), F.col("class"))).cast("array<string>")
    return n.select("class", F.when(F.col("_n") > 1, clash).otherwise(F.col("path")).alias("path"))


def check_paths(paths: Paths, classes: Sequence[str]) -> None:
    """Every class exactly once, no nest with one child, no nest named like a class."""
    missing, extra = set(classes) - set(paths), set(paths) - set(classes)
    if missing or extra:
        raise ValueError(f"paths do not cover the classes: missing {sorted(missing)}, extra {sorted(extra)}")
    children: dict[str, set[str]] = {}
    for c, p in paths.items():
        chain = [*p, c]
        for parent, child in zip(chain, chain[1:]):
            children.setdefault(parent, set()).add(child)
    lonely = sorted(n for n, kids in children.items() if len(kids) < 2)
    clash = sorted(set(children) & set(classes))
    if lonely or clash:
        raise ValueError(f"nests with one child: {lonely}; nests named like a class: {clash}")


def edges(paths: Paths) -> list[tuple[str, str, str, int]]:
    """(class, node, child, depth) for every step from the root to the class."""
    return [
        (c, node, child, depth)
        for c, p in paths.items()
        for depth, (node, child) in enumerate(zip(["root", *p], [*p, c]))
    ]


def edge_column(paths: Paths, cls: str) -> Column:
    """Array of (node, child, depth) steps of a class, as a literal lookup."""
    by_class: dict[str, list] = {}
    for c, node, child, depth in edges(paths):
        by_class.setdefault(c, []).append(F.struct(F.lit(node).alias("node"), F.lit(child).alias("child"), F.lit(depth).alias("depth")))
    out = F.lit(None)
    for c, steps in by_class.items():
        out = F.when(F.col(cls) == c, F.array(*steps)).otherwise(out)
    return out


def node_shares(df: DataFrame, keys: Sequence[str], cls: str, share: str, paths: Paths, min_rows: int = 1) -> DataFrame:
    """Shares of each node's children within the node, for rows with mass there.

    A node with fewer rows than ``min_rows`` is marked ``even``: its children split evenly in prediction.
    """
    steps = df.withColumn("_e", F.explode(edge_column(paths, cls)))
    sums = steps.groupBy(*keys, F.col("_e.node").alias("node"), F.col("_e.child").alias("child")).agg(F.sum(share).alias("_s"))
    total = F.sum("_s").over(Window.partitionBy(*keys, "node"))
    sums = sums.withColumn("_t", total).where(F.col("_t") > 0)
    sums = sums.select(*keys, "node", "child", (F.col("_s") / F.col("_t")).alias("share"))
    rows = sums.select(*keys, "node").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("n_rows"))
    return sums.join(rows, "node").withColumn("even", F.col("n_rows") < min_rows)
