"""Join forms used by the panel: fan-out, as-of, lattice, distance band, fallback chains, class pairs, crosswalks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridpanel.plans.skew import join_null_safe, range_bucketed, salted_join


def full_outer_fold(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of several tables on the same keys."""
    return reduce(lambda a, b: a.join(b, list(keys), "full"), tables)


def expand_weighted(df: DataFrame, crosswalk: DataFrame, on: Sequence[str], value: str, weight: str, salts: int = 1) -> DataFrame:
    """Many-to-many expansion: each source row spreads over its crosswalk rows by weight (NULL weight counts 1).

    Aggregate ``df`` to its join keys first.  ``salts`` > 1 spreads a hot crosswalk key over several tasks.
    """
    joined = salted_join(df, crosswalk, on, salts) if salts > 1 else df.join(crosswalk, list(on))
    return joined.withColumn(value, F.col(value) * F.coalesce(F.col(weight), F.lit(1.0)))


def expand_grid(df: DataFrame, **values: Sequence) -> DataFrame:
    """Cross every row with short literal lists (model years, species, classes): a generator, not a cross join."""
    for name, items in values.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(i) for i in items])))
    return df


def _around(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, when: str, cols: Sequence[str], after: bool) -> DataFrame:
    """Left rows with ``_past``, the last right row at or before ``at``, and with ``after`` also ``_next``, the first one at or behind it.

    The distinct (key, time) points of both sides are dealt by range of (key, time). A window inside a range finds the neighbours there; what a range
    lacks comes from the ends of the ranges before or behind it, one row per key and range. No task holds the history of a key.
    """
    entry = F.struct(F.col(when).alias("w"), *[F.col(c) for c in cols])
    known = right.where(F.col(when).isNotNull()).groupBy(*keys, F.col(when).alias("_t")).agg(F.max(entry).alias("_e"))
    asked = left.select(*keys, F.col(at).alias("_t")).where(F.col("_t").isNotNull()).distinct().withColumn("_e", F.lit(None).cast(known.schema["_e"].dataType))
    points = known.unionByName(asked).groupBy(*keys, "_t").agg(F.max("_e").alias("_e"))
    dealt = range_bucketed(points, keys, ["_t"])

    def nearest(inside: WindowSpec, outside: WindowSpec, name: str) -> tuple[Column, Column]:
        own = F.last("_e", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
        ends = F.last(f"_end{name}", ignorenulls=True).over(outside.rowsBetween(Window.unboundedPreceding, -1))
        return own.alias(f"_own{name}"), ends.alias(f"_far{name}")

    inside, outside = Window.partitionBy(*keys, "_b"), Window.partitionBy(*keys)
    sides = [nearest(inside.orderBy("_t"), outside.orderBy("_b"), "_past")]
    if after:
        sides.append(nearest(inside.orderBy(F.desc("_t")), outside.orderBy(F.desc("_b")), "_next"))
    ends = dealt.where(F.col("_e").isNotNull()).groupBy(*keys, "_b").agg(F.max_by("_e", "_t").alias("_end_past"), F.min_by("_e", "_t").alias("_end_next"))
    ranges = dealt.select(*keys, "_b").distinct()
    far = join_null_safe(ranges, ends, [*keys, "_b"], "left").select(*keys, "_b", *[f for _, f in sides])
    near = dealt.select(*keys, "_b", "_t", *[o for o, _ in sides])
    names = ["_past", "_next"] if after else ["_past"]
    found = join_null_safe(near, far, [*keys, "_b"]).select(*keys, F.col("_t").alias(at), *[F.coalesce(f"_own{n}", f"_far{n}").alias(n) for n in names])
    return left.join(found, [*keys, at], "left")


def latest_before(
    left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, when: str, cols: Sequence[str]
) -> DataFrame:
    """Backward as-of join: the latest right row per key with ``when`` ≤ ``at`` (unmatched left rows keep NULLs).

    Of right rows that share key and time the largest (``cols`` in order) counts; rows of a null key or time match nothing. Each left row comes once.
    """
    out = _around(left, right, keys, at, when, cols, after=False)
    return out.select(*left.columns, F.col("_past.w").alias(f"matched_{when}"), *[F.col(f"_past.{c}").alias(c) for c in cols])


def nearest_vintage(
    left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, when: str, cols: Sequence[str]
) -> DataFrame:
    """Nearest available year per key; at equal distance the earlier year wins.  Same plan as ``latest_before``, in both directions."""
    out = _around(left, right, keys, at, when, cols, after=True)
    later = F.col("_past").isNull() | (F.col("_next.w") - F.col(at) < F.col(at) - F.col("_past.w"))
    out = out.withColumn("_m", F.when(later, F.col("_next")).otherwise(F.col("_past")))
    return out.select(*left.columns, F.col("_m.w").alias(f"matched_{when}"), *[F.col(f"_m.{c}").alias(c) for c in cols])


def neighbour_offsets(reach: int, centre: bool = False) -> Column:
    """Literal array of lattice offsets within ``reach`` cells (queen neighbourhood)."""
    span = range(-reach, reach + 1)
    pairs = [(dx, dy) for dx in span for dy in span if centre or (dx, dy) != (0, 0)]
    return F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dx, dy in pairs])


def offset_join(
    cells: DataFrame, values: DataFrame, ix: str, iy: str, by: Sequence[str], reach: int = 1, centre: bool = False
) -> DataFrame:
    """Range join on a lattice as an equi join: each value row is sent to the cells around it.

    ``values`` must hold one row per lattice position (and class), so the fan-out is the fixed window size.
    """
    spread = values.withColumn("_o", F.explode(neighbour_offsets(reach, centre)))
    spread = spread.withColumn(ix, F.col(ix) + F.col("_o.dx")).withColumn(iy, F.col(iy) + F.col("_o.dy")).drop("_o")
    return cells.join(spread, [*by, ix, iy])


def distance_band(points: DataFrame, x: str, y: str, key: str, band: float) -> DataFrame:
    """Ordered pairs of distinct positions no farther apart than ``band``.

    ``points`` holds one row per position.  Positions fall into squares of side ``band``; a pair can only sit in the same
    or an adjacent square, so one side is sent to nine squares and the equi join is filtered by distance.
    """
    a = points.select(
        F.col(key).alias("id_a"), F.col(x).alias("xa"), F.col(y).alias("ya"),
        F.floor(F.col(x) / band).alias("bx"), F.floor(F.col(y) / band).alias("by"),
    )
    b = points.select(
        F.col(key).alias("id_b"), F.col(x).alias("xb"), F.col(y).alias("yb"),
        F.explode(neighbour_offsets(1, centre=True)).alias("o"),
    )
    b = b.withColumn("bx", F.floor(F.col("xb") / band) + F.col("o.dx")).withColumn(
        "by", F.floor(F.col("yb") / band) + F.col("o.dy")
    ).drop("o")
    dx, dy = F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")
    near = dx * dx + dy * dy <= F.lit(float(band) ** 2)
    return a.join(b, ["bx", "by"]).where(near).select("id_a", "id_b", F.sqrt(dx * dx + dy * dy).alias("dist"))


def lookup_with_fallback(df: DataFrame, table: DataFrame, key: str, value: str, prefix: int = 2, out: str | None = None) -> DataFrame:
    """Exact key, else its first ``prefix`` characters, else the mean of the table; records which rung served."""
    exact = table.select(F.col(key).alias("_k1"), F.col(value).alias("_v1"))
    coarse = table.select(F.col(key).alias("_k2"), F.col(value).alias("_v2"))
    mean = table.agg(F.avg(value).alias("_v3")).withColumn("_one", F.lit(1))
    joined = (
        df.join(exact, F.col(key) == F.col("_k1"), "left")
        .join(coarse, F.substring(F.col(key), 1, prefix) == F.col("_k2"), "left")
        .withColumn("_one", F.lit(1))
        .join(mean, "_one", "left")
    )
    rung = F.when(F.col("_v1").isNotNull(), "exact").when(F.col("_v2").isNotNull(), "prefix").otherwise("mean")
    value_col = F.coalesce(F.col("_v1"), F.col("_v2"), F.col("_v3"))
    return joined.withColumn(out or value, value_col).withColumn("rung", rung).drop("_k1", "_k2", "_v1", "_v2", "_v3", "_one")


def class_pairs(df: DataFrame, keys: Sequence[str], cls: str, value: str, classes: Sequence[str], ordered: bool = True) -> DataFrame:
    """Differences ``to − from`` for class pairs of one key.

    A key's values are gathered into a class-indexed map by one partial aggregate (bounded by the class list), then the
    pair list is generated in the row: no self join, no shuffle of pairs.
    """
    wide = df.groupBy(*keys).agg(*[F.max(F.when(F.col(cls) == c, F.col(value))).alias(f"_c{i}") for i, c in enumerate(classes)])
    pairs = [
        F.struct(
            F.lit(a).alias("from_class"), F.lit(b).alias("to_class"), (F.col(f"_c{j}") - F.col(f"_c{i}")).alias("diff")
        )
        for i, a in enumerate(classes) for j, b in enumerate(classes) if (i != j if ordered else i < j)
    ]
    return wide.select(*keys, F.explode(F.array(*pairs)).alias("_p")).select(*keys, "_p.*").where(F.col("diff").isNotNull())


def crosswalk_join(df: DataFrame, crosswalk: DataFrame, key: str, source: str, target: str, min_kept: float = 0.95) -> DataFrame:
    """Translate ids through a crosswalk (first target per source id) and fail when too few ids survive.

    The gate is one aggregate job; it raises before the translated table is used.
    """
    first = (
        crosswalk.where(F.col(source).isNotNull() & F.col(target).isNotNull())
        .groupBy(F.col(source).alias(key)).agg(F.min(target).alias("_to"))
    )
    share = crosswalk_coverage(df, first, key).first()["kept_share"]
    if share is not None and share < min_kept:
        raise ValueError(f"crosswalk kept only {100 * share:.1f}% of ids (need {100 * min_kept:.0f}%)")
    return df.join(first, key).withColumn(key, F.col("_to")).drop("_to")


def crosswalk_coverage(df: DataFrame, crosswalk: DataFrame, key: str) -> DataFrame:
    ids = df.select(key).distinct()
    known = crosswalk.select(key).distinct().withColumn("_in", F.lit(1))
    return ids.join(known, key, "left").agg(
        F.count(F.lit(1)).alias("n_ids"), F.count("_in").alias("n_kept"), F.avg(F.coalesce(F.col("_in"), F.lit(0))).alias("kept_share")
    )


def rounded_coordinate_join(left: DataFrame, right: DataFrame, coord: Sequence[str], digits: int = 0, how: str = "left") -> DataFrame:
    """Join on coordinates rounded to ``digits`` decimals; the right side's own coordinates are dropped."""
    keys = [f"_r_{c}" for c in coord]
    lhs = left.withColumns({k: F.round(F.col(c), digits) for k, c in zip(keys, coord)})
    rhs = right.withColumns({k: F.round(F.col(c), digits) for k, c in zip(keys, coord)}).drop(*coord)
    return lhs.join(rhs, keys, how).drop(*keys)
