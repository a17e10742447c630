"""Class mapping, filters and column selection on long cell tables (cell, class, area)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.functions.scalar import blank_to_null, finite_or, syntactic_name

NODATA = "NODATA"


def map_classes(
    df: DataFrame, lookup: DataFrame, on: str, cls: str, area: str = "area", strict: bool = True
) -> DataFrame:
    """Left join a code → class lookup.  With ``strict``, a positive area without a class fails the job.

    The check is an expression inside the plan (``raise_error``), so it costs no extra pass.  The lookup is planned as a
    broadcast only when its measured size is below Spark's threshold.
    """
    out = df.join(lookup, on, "left")
    if strict:
        lost = F.col(cls).isNull() & (F.col(area) > 0)
        message = F.concat(F.lit("unmapped code with positive area: "), F.col(on).cast("string"))
        out = out.withColumn(cls, F.when(lost, F.raise_error(message).cast("string")).otherwise(F.col(cls)))
    return out


def compose_class(df: DataFrame, cols: Sequence[str], out: str = "model_class") -> DataFrame:
    """Join the non-blank label columns with '_' into a valid name; all blank → NODATA."""
    joined = F.concat_ws("_", *[blank_to_null(F.col(c)) for c in cols])
    return df.withColumn(out, F.when(joined == "", F.lit(NODATA)).otherwise(syntactic_name(joined)))


# Label pattern, suffix, and the pattern (underscores removed) that shows the suffix is already there.
SUFFIX_RULES = (("organic", "_O", "O$"), ("irrigat", "_IR", "IR"))


def suffix_classes(
    df: DataFrame, label: str, cls: str = "model_class", rules: Sequence[tuple[str, str, str]] = SUFFIX_RULES
) -> DataFrame:
    """Append a suffix where the label asks for one and the class does not carry it; fail on a NODATA class."""
    text = F.lower(F.coalesce(F.col(label), F.lit("")))
    for pattern, suffix, present in rules:
        hit = text.rlike(pattern)
        carries = F.regexp_replace(F.col(cls), "_", "").rlike(present)
        fail = F.raise_error(F.concat(F.lit(f"label asks for {suffix} but the class is {NODATA}: "), F.col(label)))
        df = df.withColumn(
            cls,
            F.when(hit & (F.col(cls) == NODATA), fail.cast("string"))
            .when(hit & ~carries, F.concat(F.col(cls), F.lit(suffix)))
            .otherwise(F.col(cls)),
        )
    return df


def fold_classes(
    df: DataFrame, members: Sequence[str], into: str = "no_choice", cls: str = "model_class", base: str | None = None
) -> DataFrame:
    """Fold a set of classes into one; ``focal_class`` keeps the granular name."""
    hit = F.col(cls).isin(*members)
    if base:
        hit = hit | F.coalesce(F.col(base).isin(*members), F.lit(False))
    return df.withColumn("focal_class", F.col(cls)).withColumn(cls, F.when(hit, F.lit(into)).otherwise(F.col(cls)))


def derive_subclass(
    df: DataFrame,
    base: str,
    management: str,
    reporting: str,
    unmanaged: str,
    refinements: Sequence[tuple[str, str]],
    out: str = "subclass",
) -> DataFrame:
    """Three tiers: managed name (base_management), refinement of the unmanaged base by report label, base name."""
    b, m, r = (blank_to_null(F.col(c)) for c in (base, management, reporting))
    refined = F.lit(None).cast("string")
    for text, name in refinements:
        refined = F.when(F.contains(r, F.lit(text)), F.lit(name)).otherwise(refined)
    managed = F.when(b.isNotNull() & m.isNotNull(), F.concat_ws("_", b, m))
    value = F.coalesce(managed, F.when(b == unmanaged, refined), b)
    blank = F.raise_error(F.lit("subclass came out blank")).cast("string")
    return df.withColumn(out, F.coalesce(value, blank))


def diff_mapping(old: DataFrame, new: DataFrame, key: str, col: str, label: str | None = None) -> DataFrame:
    """Was/now report of the rows whose class changed."""
    left = old.select(key, F.col(col).alias("was"))
    right = new.select(key, *([label] if label else []), F.col(col).alias("now"))
    return left.join(right, key).where(~F.col("was").eqNullSafe(F.col("now")))


def filter_labels(df: DataFrame, label: str, pattern: str) -> DataFrame:
    """Drop source rows whose label matches a switched-off feature."""
    return df.where(~F.lower(F.coalesce(F.col(label), F.lit(""))).rlike(pattern))


def filter_cells(
    df: DataFrame, cell: Sequence[str], area: str = "area", min_area: float = 1.0, scope: DataFrame | None = None
) -> DataFrame:
    """Positive areas, cells in scope, and cells whose total reaches ``min_area`` (slivers go)."""
    df = df.where(F.col(area) > 0)
    if scope is not None:
        df = df.join(scope.select(*cell).distinct(), list(cell), "left_semi")
    big = df.groupBy(*cell).agg(F.sum(area).alias("_t")).where(F.col("_t") >= min_area).select(*cell)
    return df.join(big, list(cell), "left_semi")


def complete_cases(df: DataFrame, cols: Sequence[str], area: str) -> tuple[DataFrame, DataFrame]:
    """Rows with every essential column, and one report row per column: share of NULLs and area lost."""
    kept = df.dropna(subset=list(cols))
    measures = []
    for c in cols:
        missing = F.col(c).isNull()
        measures.append(F.avg(missing.cast("double")).alias(f"{c}|null_fraction"))
        measures.append(F.coalesce(F.sum(F.when(missing, F.col(area))), F.lit(0.0)).alias(f"{c}|area_lost"))
    one = df.agg(*measures)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"`{c}|null_fraction`").alias("null_fraction"),
                F.col(f"`{c}|area_lost`").alias("area_lost"),
            )
            for c in cols
        ]
    )
    return kept, one.select(F.explode(rows).alias("r")).select("r.*")


def clean_numeric(df: DataFrame, cols: Sequence[str], policy: str) -> DataFrame:
    """``nan_to_null``, ``nonfinite_to_zero`` or ``null_to_zero`` on the given columns."""
    def fix(c: str):
        x = F.col(c).cast("double")
        if policy == "nan_to_null":
            return F.when(~F.isnan(x), x)
        if policy == "nonfinite_to_zero":
            return finite_or(x, F.lit(0.0))
        if policy == "null_to_zero":
            return F.coalesce(x, F.lit(0.0))
        raise ValueError(f"unknown policy {policy!r}")

    return df.withColumns({c: fix(c) for c in cols})


def drop_empty_classes(df: DataFrame, cls: str, area: str) -> DataFrame:
    """Keep only classes with a non-zero total anywhere."""
    live = df.groupBy(cls).agg(F.sum(area).alias("_t")).where(F.coalesce(F.col("_t"), F.lit(0.0)) != 0).select(cls)
    return df.join(live, cls, "left_semi")


def select_vintage(df: DataFrame, keys: Sequence[str], stems: Sequence[str], year: int, rule: dict | str) -> DataFrame:
    """Pick the year-suffixed columns that serve ``year`` and give them their generic names.

    ``rule`` is a fixed map year → vintage, or ``"forward"``: the first available vintage at or after the year,
    else the latest before it.
    """
    picks = {}
    for stem in stems:
        found = sorted(int(m.group(1)) for c in df.columns if (m := re.fullmatch(rf"{re.escape(stem)}_(\d{{4}})", c)))
        if not found:
            raise ValueError(f"no vintages for {stem}")
        if rule == "forward":
            later = [y for y in found if y >= year]
            vintage = later[0] if later else found[-1]
        else:
            vintage = rule[year]
        picks[stem] = f"{stem}_{vintage}"
    return df.select(*keys, *[F.col(c).alias(stem) for stem, c in picks.items()])


def select_covariates(
    df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """Include list (all when empty) minus exclude list; columns in ``keep`` always stay."""
    chosen = [c for c in df.columns if c in keep or ((not include or c in include) and c not in exclude)]
    return df.select(*chosen)


def default_outcome(df: DataFrame, keys: Sequence[str], classes: Sequence[str], cls: str, area: str) -> DataFrame:
    """Complete every key over the class list with area 0 (a dummy outcome when no class exists)."""
    names = list(classes) or ["no_choice"]
    grid = df.select(*keys).distinct().withColumn(cls, F.explode(F.array(*[F.lit(n) for n in names])))
    return grid.join(df, [*keys, cls], "left").withColumn(area, F.coalesce(F.col(area), F.lit(0.0)))


def class_set_change(current: Sequence[str], retire: Sequence[str], mint: Sequence[str]) -> list[str]:
    """Order-sensitive retire-then-mint on a class list."""
    kept = [c for c in current if c not in set(retire)]
    return kept + [c for c in mint if c not in kept]
