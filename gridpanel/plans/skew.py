"""Plan shapes that stay balanced when one key holds a large part of all rows.

Spark sends one window partition to one task.  A running total, rank or exact quantile over a hot key would
therefore collect that key in a single task.  The functions here cut every key into ordered buckets first, compute the
running value inside each bucket and add the (small) sum of the earlier buckets.  Results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.session import written

HASH_BITS = 52  # 13 hexadecimal digits: exact in a double and in a bigint


def keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Give an ungrouped table a constant key, so that grouped code serves both cases."""
    return (df, list(keys)) if keys else (df.withColumn("_all_rows", F.lit(1)), ["_all_rows"])


def with_group_values(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach group aggregates by partial aggregation and a join, instead of a window over the whole group."""
    df, ks = keyed(df, keys)
    values = df.groupBy(*ks).agg(*[c.alias(n) for n, c in aggs.items()])
    renamed = values.select(*[F.col(k).alias(f"_g_{k}") for k in ks], *aggs)
    cond = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in ks]
    return df.join(renamed, cond, "left").drop(*[f"_g_{k}" for k in ks], *([] if keys else ks))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which null keys meet: rows of a null group are rows like any other."""
    names = {k: f"_r_{k}" for k in keys}
    cond = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(right.withColumnsRenamed(names), cond, how).drop(*names.values())


def running_total(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Exact running sum of ``value`` per key in ``order``; ``bucket`` must not decrease along ``order``.

    Adds ``out`` (sum up to and including the row) and ``<out>_all`` (sum over the key).
    """
    df, ks = keyed(df, keys)
    sums = df.groupBy(*ks, bucket).agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*ks).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *ks,
        bucket,
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"),
        F.sum("_s").over(Window.partitionBy(*ks)).alias(f"{out}_all"),
    )
    inside = Window.partitionBy(*ks, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        join_null_safe(df, offsets, [*ks, bucket])
        .withColumn(out, F.sum(value).over(inside) + F.col("_off"))
        .drop("_off", *([] if keys else ks))
    )


def dense_index(df: DataFrame, keys: Sequence[str], order: str, out: str, width: int = 65536) -> DataFrame:
    """Number the rows of each key 1..n along a unique integer column; one task sees at most ``width`` ids."""
    df = df.withColumn("_b", F.floor(F.col(order) / width)).withColumn("_u", F.lit(1).cast("long"))
    return running_total(df, keys, "_b", [order], "_u", out).drop("_b", "_u", f"{out}_all")


def hash_order(seed: int, *cols: str) -> Column:
    """Reproducible pseudo-random order key, uniform on [0, 2**52); the same in any engine with MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def hash_bucket(order: str, buckets: int) -> Column:
    return F.floor(F.col(order) / F.lit(float(2**HASH_BITS) / buckets))


ORDERED_ROWS = 50_000  # rows of a key that a selection may order in one task
DIGIT_BITS = 12  # bits of the hash that a round of a selection counts by


def take_by_hash(
    df: DataFrame, keys: Sequence[str], ids: Sequence[str], quota: Column, seed: int, out: str, constant: Sequence[str] = ()
) -> DataFrame:
    """Mark the ``quota`` rows of each key that come first in hash order.

    ``quota`` may use column ``n`` (key size) and the columns ``constant``, which have one value within a key.

    The hash where a key's quota ends is found digit by digit: a round counts the rows of the range that holds it by the next digit, and the digit in
    which the quota is used up is the next range. Only when at most ``ORDERED_ROWS`` rows of a key are left in its range are these ordered; all others
    lie before or behind it and are marked in place, without a shuffle or a sort. Rows that agree in hash and ids stand in any order.
    """
    df, ks = keyed(df, keys)
    src = df.withColumn("_h", hash_order(seed, *ids))
    size = 2**HASH_BITS
    # per key: start of the range, what is left of the quota there, and the rows in it
    state = src.groupBy(*ks, *constant).agg(F.count(F.lit(1)).alias("n")).select(*ks, F.lit(0).cast("long").alias("_lo"), F.floor(quota).cast("long").alias("_left"), F.col("n").alias("_rows"))
    state = written(state)
    while size > 1 and (state.agg(F.max("_rows")).first()[0] or 0) > ORDERED_ROWS:
        step = max(1, size >> DIGIT_BITS)
        inside = join_null_safe(src.select(*ks, "_h"), state, ks).where((F.col("_h") >= F.col("_lo")) & (F.col("_h") < F.col("_lo") + size))
        counts = inside.groupBy(*ks, "_lo", "_left", F.floor((F.col("_h") - F.col("_lo")) / F.lit(step)).alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
        before = Window.partitionBy(*ks).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)  # a row per digit
        counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        # a quota that reaches behind the range takes it whole
        ends = F.min(F.when(F.col("_before") + F.col("_c") > F.col("_left"), F.struct("_d", "_before", "_c")))
        found = counts.groupBy(*ks, "_lo", "_left").agg(ends.alias("_e"))
        state = written(found.select(
            *ks, F.when(F.col("_e").isNull(), F.col("_lo") + size).otherwise(F.col("_lo") + F.col("_e._d") * step).alias("_lo"),
            F.when(F.col("_e").isNull(), F.lit(0)).otherwise(F.col("_left") - F.col("_e._before")).cast("long").alias("_left"), F.coalesce("_e._c", F.lit(0)).alias("_rows")))
        size = step
    placed = join_null_safe(src, state.drop("_rows"), ks)
    inside = (F.col("_h") >= F.col("_lo")) & (F.col("_h") < F.col("_lo") + size)
    rank = F.row_number().over(Window.partitionBy(*ks).orderBy("_h", *ids))
    settled = placed.where(~inside).withColumn(out, F.col("_h") < F.col("_lo"))
    ordered = placed.where(inside).withColumn(out, F.coalesce(rank <= F.col("_left"), F.lit(False)))
    return settled.unionByName(ordered).drop("_h", "_lo", "_left", *([] if keys else ks))


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values of each key (``_v``) with their counts (``_n``).

    An operator that needs several statistics of a costly table can checkpoint this and hand it to ``group_quantiles``.
    """
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))


def range_bucketed(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Written copy of ``df`` dealt by ranges of (``keys``, ``order``): ``_b`` numbers the range and does not decrease along ``order`` within a key.

    Like a global sort, Spark samples the range bounds, so a bucket holds about one partition's rows whatever the size of a key, and the number of
    buckets follows ``spark.sql.shuffle.partitions``. Rows that agree in all these columns share a bucket: make them distinct first. The copy is
    written, because the bounds must be the same for all who read the buckets.
    """
    return written(df.repartitionByRange(*keys, *order).withColumn("_b", F.spark_partition_id()))


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    bounded: bool = False,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Exact interpolated quantiles (type 7) per key: one column per entry of ``probs``.

    ``bounded=True`` says that a key holds few rows (for instance thinned draws of one parameter) and uses the
    built-in ``percentile``, which keeps a key's distinct values in memory.  Otherwise each key is reduced to
    value counts, these are dealt by range, and only the ranges that hold a wanted rank are sorted.  ``counts`` passes ready
    value counts of the same keys.
    """
    df, ks = keyed(df, keys)
    if bounded:
        v = F.col(value).cast("double")
        out = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*ks)
        return out.agg(*[F.percentile(v, F.lit(p)).alias(n) for n, p in probs.items()]).drop("_all_rows")
    counts = range_bucketed(value_counts(df, ks, value) if counts is None else counts, ks, ["_v"])
    sums = counts.groupBy(*ks, "_b").agg(F.sum("_n").alias("_s"))
    before = Window.partitionBy(*ks).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *ks,
        "_b",
        "_s",
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"),
        F.sum("_s").over(Window.partitionBy(*ks)).alias("_tot"),
    )
    pos = {n: (F.col("_tot") - 1) * F.lit(float(p)) for n, p in probs.items()}
    wanted = F.lit(False)
    for h in pos.values():
        for r in (F.floor(h), F.ceil(h)):
            wanted = wanted | ((r >= F.col("_off")) & (r < F.col("_off") + F.col("_s")))
    inside = Window.partitionBy(*ks, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        join_null_safe(counts, sums.where(wanted).drop("_s"), [*ks, "_b"])
        .withColumn("_hi", F.sum("_n").over(inside) + F.col("_off"))
        .withColumn("_lo", F.col("_hi") - F.col("_n"))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_lo") <= rank) & (rank < F.col("_hi")), F.col("_v")))

    picked = ranked.groupBy(*ks).agg(
        F.first("_tot").alias("_tot"),
        *[at(F.floor(h)).alias(f"_f_{n}") for n, h in pos.items()],
        *[at(F.ceil(h)).alias(f"_c_{n}") for n, h in pos.items()],
    )
    return picked.select(
        *keys,
        *[
            (F.col(f"_f_{n}") + (h - F.floor(h)) * (F.col(f"_c_{n}") - F.col(f"_f_{n}"))).alias(n)
            for n, h in pos.items()
        ],
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Add the 1-based rank of ``value`` within the key (ties share their mean rank) and ``<out>_n``, the key size.

    Rows without a value stay and have no rank; rows of a null key are ranked among themselves.
    """
    df, ks = keyed(df, keys)
    counts = range_bucketed(value_counts(df, ks, value), ks, ["_v"])
    ranked = running_total(counts, ks, "_b", ["_v"], "_n", "_cum")
    ranked = ranked.select(
        *ks,
        F.col("_v"),
        (F.col("_cum") - (F.col("_n") - 1) / 2).alias(out),
        F.col("_cum_all").alias(f"{out}_n"),
    )
    src = df.withColumn("_v", F.col(value).cast("double"))
    return join_null_safe(src, ranked, [*ks, "_v"], "left").drop("_v", *([] if keys else ks))


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], salts: int = 8, how: str = "inner") -> DataFrame:
    """Equi join for a many-to-many fan-out with hot keys: ``big`` rows of a key spread over ``salts`` tasks.

    The salt is a hash of the row's own values, so a recomputed task sends every row to the same place again.
    """
    spread = F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")
    copies = F.explode(F.array(*[F.lit(i) for i in range(salts)]))
    left = big.withColumn("_salt", spread)
    right = small.withColumn("_salt", copies)
    return left.join(right, [*on, "_salt"], how).drop("_salt")
