"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source, documents lie in key order: buckets of the key are summed first, prefix sums over the
buckets find the one in which the budget ends, and only that bucket is ordered row by row. A source is cut at its exact budget; a budget
above its size takes whole epochs first. A source with any share of the rows is spread over all buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.llm.common import fresh, word_count
from gridpanel.session import written

WEIGHTS = (5, 2, 1)
SHARE, EPOCHS = 1.5, 2
BUCKET_ROWS = 20_000
SEED = 20_261


def _key():
    return F.xxhash64(F.col("doc_id").cast("string"), F.lit(SEED))


def source_targets(sources: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights: tuple = WEIGHTS) -> DataFrame:
    """``target`` for each row of ``sources(source, source_size)``: ``share`` of all sizes by weight, at most ``epochs`` times the source.

    Sources in code point order (null last) weigh ``weights``, repeating. What exceeds a source's limit is shared again by weight until no
    source is above its limit. Ranks come from a range partition and its counts, so that any number of sources is ordered.
    """
    ordered = written(sources.withColumn("last", F.col("source").isNull()).repartitionByRange(8, "last", F.col("source").cast("binary"))
                      .sortWithinPartitions("last", F.col("source").cast("binary")).select("source", "source_size", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    before, total = {}, 0
    for p, n in sorted(tuple(r) for r in ordered.groupBy(part.alias("p")).count().collect()):  # one row for each of the partitions
        before[p], total = total, total + n
    start = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv]), part) if before else F.lit(0)
    rank = start + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = written(ordered.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * epochs).cast("double").alias("limit")))
    rate, budget = 0.0, None
    while True:  # each round fixes the sources above their limit; the rate only rises
        full = F.col("limit") <= F.col("weight") * rate
        size, fixed, free = ranked.agg(F.sum("source_size"), F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight")))).first()
        budget = share * (size or 0)
        following = (budget - (fixed or 0.0)) / free if free else math.inf
        if not free or following <= rate * (1 + 1e-12):
            break
        rate = following
    target = F.least("limit", F.col("weight") * F.lit(rate)) if rate else F.lit(0.0)
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def source_cuts(slim: DataFrame) -> DataFrame:
    """Where each source is cut: source_size, target, epochs (whole), and the key, id, rest and tied words of the last document.

    ``slim(source, doc_id, size, key)``; documents whose (key, doc_id) is below the cut are taken once more than ``epochs``.
    """
    bits = max(0, math.ceil(math.log2(max(1, slim.count() / BUCKET_ROWS))))
    slim = slim.withColumn("bucket", F.shiftright("key", 64 - bits) if bits else F.lit(0).cast("long"))
    buckets = written(slim.groupBy("source", "bucket").agg(F.sum("size").alias("size")))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("size").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("epochs", whole.cast("long"))
    targets = written(targets.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    running = buckets.withColumn("upto", F.sum("size").over(order)).alias("b")
    t = targets.alias("t")
    hit = running.join(t, F.col("b.source").eqNullSafe(F.col("t.source"))).where("upto >= rest and upto - size < rest").select(
        F.col("t.source").alias("s"), F.col("bucket").alias("k"), (F.col("rest") - (F.col("upto") - F.col("size"))).alias("left"))
    inside = slim.join(hit, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("k")))
    tied = inside.groupBy("source", "left", "key", "doc_id").agg(F.sum("size").alias("size"))
    within = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = tied.withColumn("upto", F.sum("size").over(within)).where("upto >= left and upto - size < left").select(
        F.col("source").alias("s"), F.struct("key", "doc_id").alias("cut"), (F.col("left") - (F.col("upto") - F.col("size"))).alias("part"),
        F.col("size").alias("tied"))
    out = targets.join(cut, F.col("source").eqNullSafe(F.col("s")), "left")
    return written(out.select(F.col("source").alias("s"), "source_size", "target", "epochs", "cut", "part", "tied"))


def mix(docs: DataFrame) -> DataFrame:
    """Adds size, source_size, target and taken (words the mix takes of a document, repeats counted) to every row of ``docs``.

    The last document of a source is taken in part, so that a source's taken words are its rounded target (rows that repeat the id of the last
    document share what is left of it, rounded down). Null texts and texts without words have size 0 and taken 0; a source without words has
    target 0; null is a source of its own; columns of these four names are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    slim = written(docs.select("source", "doc_id", word_count(F.col("text")).alias("size"), _key().alias("key")))
    return apply_cuts(docs.withColumn("size", word_count(F.col("text"))), source_cuts(slim))


def mix_sizes(docs: DataFrame) -> DataFrame:
    """``mix`` without the other columns: the texts are read once, for their sizes."""
    slim = written(docs.select("source", "doc_id", word_count(F.col("text")).alias("size"), _key().alias("key")))
    return apply_cuts(slim.select("source", "doc_id", "size"), source_cuts(slim)).drop("source")


def apply_cuts(sized: DataFrame, cuts: DataFrame) -> DataFrame:
    names = {c: n for c, n in zip(cuts.columns, fresh(*cuts.columns), strict=True)}
    c = {k: F.col(v) for k, v in names.items()}
    mine = F.struct(_key().alias("key"), F.col("doc_id"))
    last = F.when(mine < c["cut"], F.col("size")).when(mine == c["cut"], F.floor(F.col("size") * c["part"] / c["tied"])).otherwise(0)
    joined = sized.join(cuts.withColumnsRenamed(names), F.col("source").eqNullSafe(c["s"]))
    taken = (c["epochs"] * F.col("size") + F.coalesce(last, F.lit(0))).cast("long")
    return joined.withColumns({"source_size": c["source_size"], "target": c["target"], "taken": taken}).drop(*names.values())
