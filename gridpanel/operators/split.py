"""Spatially honest hold-outs.  Random order is a hash of the row key, so a split is reproducible on any cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.operators.focal import buffer_ring, tile_key
from gridpanel.plans.skew import hash_bucket, hash_order, running_total, take_by_hash, with_group_values
from gridpanel.session import cut_lineage


def split_random(df: DataFrame, ids: Sequence[str], frac: float, seed: int, out: str = "test") -> DataFrame:
    """Hold out round(frac · n) rows; exact, from the rank of the hash."""
    return take_by_hash(df, [], ids, F.bround(F.col("n") * F.lit(frac)), seed, out)


def split_stratified(df: DataFrame, ids: Sequence[str], group: str, frac: float, seed: int, out: str = "test") -> DataFrame:
    """Hold out round(frac · n) rows of every group and always leave one training row."""
    quota = F.least(F.col("n") - 1, F.greatest(F.bround(F.col("n") * F.lit(frac)), F.lit(0)))
    return take_by_hash(df, [group], ids, quota, seed, out)


def subsample(df: DataFrame, ids: Sequence[str], n: int, seed: int) -> DataFrame:
    """Fixed-size subsample in hash order."""
    return take_by_hash(df, [], ids, F.lit(n), seed, "_keep").where(F.col("_keep")).drop("_keep")


def thin(draws: DataFrame, keys: Sequence[str], order: str, max_draws: int) -> DataFrame:
    """Regular thinning so that a key keeps at most ``max_draws`` draws; ``order`` counts draws from 1."""
    df = with_group_values(draws, keys, _last=F.max(order))
    step = F.greatest(F.ceil(F.col("_last") / F.lit(max_draws)), F.lit(1))
    return df.where(F.pmod(F.col(order) - 1, step) == 0).drop("_last")


def choose_blocks(
    cells: DataFrame, ix: str, iy: str, group: str, side: int, target: float, min_train: int, seed: int
) -> DataFrame:
    """Whole tiles in hash order for a block hold-out of about ``target`` rows.

    A tile is refused when it and the tiles accepted before it would leave one of its groups below ``min_train`` rows.  Accepted
    tiles are taken until the target is reached.  Returns one row per chosen tile.

    The sequential rule is found as a fixpoint: running totals over the tiles accepted so far say which tiles fit, and this
    repeats until the accepted set stays; every round settles at least one more tile, and mostly all at once.
    """
    tiles = cells.withColumn("tile", tile_key(ix, iy, side)).groupBy("tile", group).agg(F.count(F.lit(1)).alias("_n"))
    tiles = tiles.withColumn("_h", hash_order(seed, "tile")).withColumn("_b", hash_bucket("_h", 256))
    tiles = cut_lineage(with_group_values(tiles, [group], _all=F.sum("_n")).withColumn("_use", F.lit(True)))
    while True:
        used = tiles.withColumn("_m", F.when(F.col("_use"), F.col("_n")).otherwise(0))
        run = running_total(used, [group], "_b", ["_h", "tile"], "_m", "_cum")
        left = F.col("_all") - (F.col("_cum") - F.col("_m")) - F.col("_n")
        fits = run.groupBy("tile", "_h", "_b").agg(F.min(left >= min_train).alias("_fits"), F.sum("_n").alias("_rows"))
        fits = cut_lineage(fits)
        after = tiles.join(fits.select("tile", "_fits"), "tile")
        if after.where(F.col("_fits") != F.col("_use")).isEmpty():
            break
        tiles = cut_lineage(after.withColumn("_use", F.col("_fits")).drop("_fits"))
    good = fits.where(F.col("_fits"))
    taken = running_total(good, [], "_b", ["_h", "tile"], "_rows", "_cum")
    return taken.where(F.col("_cum") - F.col("_rows") < target).select("tile", F.col("_rows").alias("n_rows"))


def split_blocks(
    df: DataFrame, ix: str, iy: str, group: str, frac: float, seed: int, side: int = 15, min_train: int = 30
) -> DataFrame:
    """Add ``test``: rows of the chosen tiles."""
    target = df.count() * frac
    tiles = choose_blocks(df, ix, iy, group, side, round(target), min_train, seed).select("tile")
    tiles = tiles.withColumn("_t", F.lit(True))
    out = df.withColumn("tile", tile_key(ix, iy, side)).join(tiles, "tile", "left")
    return out.withColumn("test", F.coalesce(F.col("_t"), F.lit(False))).drop("_t")


def spatial_split(
    df: DataFrame,
    ids: Sequence[str],
    ix: str,
    iy: str,
    group: str,
    frac: float = 0.2,
    block_share: float = 0.5,
    side: int = 15,
    reach: int = 1,
    min_train: int = 30,
    seed: int = 20260916,
) -> DataFrame:
    """Hybrid split with column ``role``: test_block, buffer, test_random or train.

    Blocks first, then the ring of ``reach`` cells around them leaves training, then the random half is drawn per group
    from what is left.
    """
    n = df.count()
    blocks = choose_blocks(df, ix, iy, group, side, round(n * frac * block_share), min_train, seed).select("tile")
    tiled = df.withColumn("tile", tile_key(ix, iy, side))
    cells = tiled.select(ix, iy, "tile").distinct()
    chosen = cells.join(blocks, "tile", "left_semi")
    ring = buffer_ring(cells, chosen, ix, iy, reach).select(ix, iy).withColumn("_zone", F.lit("buffer"))
    zones = ring.unionByName(chosen.select(ix, iy).withColumn("_zone", F.lit("test_block")))
    placed = tiled.join(zones, [ix, iy], "left").drop("tile")
    free = F.col("_zone").isNull()
    placed = with_group_values(placed, [], _free=F.count(F.when(free, 1)))
    share = F.least(F.lit(0.9), F.try_divide(F.lit(float(round(n * frac * (1 - block_share)))), F.col("_free")))
    placed = placed.withColumn("_open", free.cast("int")).withColumn("_share", share)
    quota = F.least(F.col("n") - 1, F.greatest(F.bround(F.col("_share") * F.col("n")), F.lit(0)))
    picked = take_by_hash(placed, [group, "_open"], ids, quota, seed + 1, "_pick", constant=["_share"])
    role = (
        F.when(F.col("_zone").isNotNull(), F.col("_zone"))
        .when(F.col("_pick"), F.lit("test_random"))
        .otherwise(F.lit("train"))
    )
    return picked.withColumn("role", role).drop("_zone", "_free", "_open", "_share", "_pick")


def split_summary(df: DataFrame, group: str) -> DataFrame:
    """Realised sizes per role, and the number of groups left without training rows."""
    by_group = df.groupBy(group).agg(F.max((F.col("role") == "train").cast("int")).alias("_t"))
    lost = by_group.agg(F.sum(1 - F.col("_t")).alias("groups_missing_from_train")).withColumn("_k", F.lit(1))
    roles = df.groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    roles = with_group_values(roles, [], _all=F.sum("n"))
    roles = roles.select("role", "n", (F.col("n") / F.col("_all")).alias("fraction"), F.lit(1).alias("_k"))
    return roles.join(lost, "_k").drop("_k")
