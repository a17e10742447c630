"""URL rules by an exact Bloom filter cascade.

A rule ``host/path`` fits its host, all subdomains, and every path that starts with the rule's path. The corpus's complete key universe is
the set of (host suffix, path prefix) strings of the urls that have the shape of some rule. Level 0 of a cascade encodes the listed keys,
level 1 the false positives of level 0 over that universe, level 2 the listed keys that level 1 lets through, and so on until a level has no
false positives: membership is then exact for every key of the corpus, and urls are judged by bit tests in a narrow pass, without a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.llm.common import ascii_lower, fresh
from gridpanel.session import written

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# Bits of all levels together; the levels take about 1.44 * log2(universe / listed) bits for a listed key, whatever the corpus.
MAX_BITS = 1 << 29
FILTER_BITS = 1 << 27  # of a bit table that keeps most other rows out of a join


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


@dataclass(frozen=True)
class Bloom:
    """A bit table that is read as a literal: ``words`` of 64 bits, ``hashes`` seeded hashes."""

    words: tuple[int, ...]
    bits: int
    hashes: int
    seed: int

    def table(self) -> Column:
        return F.from_json(F.lit("[" + ",".join(map(str, self.words)) + "]"), "array<bigint>")

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed + i)), F.lit(self.bits)) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        table, out = self.table(), F.lit(True)
        for p in self.positions(key):
            word = F.get(table, F.shiftright(p, 6).cast("int"))
            out = out & (F.call_function("bit_get", word, (p % 64).cast("int")) == 1)
        return out


def build_bloom(keys: DataFrame, count: int, rate: float, seed: int, bits: int = 0) -> Bloom:
    """Encode the column ``key`` of ``keys`` (``count`` rows) with false positives at ``rate``, or one hash over ``bits``; executors fold the words."""
    hashes = 1 if bits else max(1, round(math.log2(1 / rate)))
    bits = 64 * max(1, math.ceil((bits or max(1, count) * hashes / math.log(2)) / 64))
    if bits > MAX_BITS:
        raise ValueError(f"{count} listed keys need {bits} bits; split the list by top-level domain")
    empty = Bloom((), bits, hashes, seed)
    at = keys.select(F.explode(F.array(*empty.positions(F.col("key")))).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
    words = [0] * (bits // 64)
    for i, w in at.groupBy(F.shiftright("p", 6).alias("i")).agg(F.bit_or(bit).alias("w")).collect():  # at most bits / 64 rows
        words[i] = w
    return Bloom(tuple(words), bits, hashes, seed)


def cascade(listed: DataFrame, count: int, universe: DataFrame, universe_size: int, seed: int) -> list[Bloom]:
    """Levels that decide membership in ``listed`` exactly for every key of ``universe`` and ``listed`` (columns ``key``)."""
    if not count:
        return []
    rate = min(0.5, max(count, 1) * math.sqrt(0.5) / max(universe_size, 1))
    levels = [build_bloom(listed, count, rate, seed)]
    inside = listed
    outside = written(universe.where(levels[0].holds(F.col("key"))).join(listed, "key", "left_anti").distinct())
    while n := outside.count():
        levels.append(build_bloom(outside, n, 0.5, seed + 1000 * len(levels)))
        inside, outside = outside, written(inside.where(levels[-1].holds(F.col("key"))))
    return levels


def is_listed(levels: list[Bloom], key: Column) -> Column:
    """Even levels hold listed keys, odd levels keys that are not; the deepest level that was reached decides."""
    if not levels:
        return F.lit(False)
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(levels[i].holds(key), out).otherwise(F.lit(i % 2 == 1))
    return out


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Judge every row of ``pages`` by the longest fitting rule of ``rules(rule, action)``; action is ``allow`` or ``block``.

    Adds host, path, rule (null where none fits) and verdict (``default`` where none fits); input columns of these names are replaced.
    A null url, or one without ``://``, has an empty host and path, and no rule fits it. Among rules of the same length the longer host wins; a
    rule listed under both actions blocks. Repeated rows and rules change nothing; with no rules or no pages the result is plain.
    """
    labels, keys, best = fresh("labels", "keys", "best")
    cut = F.instr("rule", "/")
    rules = rules.select("rule", "action", F.size(F.split(F.substring_index("rule", "/", 1), "[.]")).alias("labels"),
                         (F.length("rule") - cut + 1).cast("int").alias("chars")).where((cut > 1) & F.col("rule").isNotNull()).distinct()
    shapes = sorted(tuple(r) for r in rules.select("labels", "chars").distinct().collect())  # a few for any list: label count x path length
    host_col, path_col = url_host(F.col(url)), url_path(F.col(url))
    out = pages.withColumns({"host": host_col, "path": path_col}).withColumn(labels, F.split("host", "[.]"))
    parts = [
        F.when((F.size(labels) >= n) & (F.length("path") >= m), F.concat(F.array_join(F.slice(labels, -n, n), "."), F.substring("path", 1, m)))
        for n, m in shapes
    ]
    candidates = F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")
    urls = pages.select(F.col(url)).withColumns({"host": host_col, "path": path_col}).withColumn(labels, F.split("host", "[.]"))
    universe = urls.select(F.explode(candidates).alias("key")).unionByName(rules.select(F.col("rule").alias("key")))
    sizes = {r["action"]: r["n"] for r in rules.groupBy("action").agg(F.countDistinct("rule").alias("n")).collect()}
    size = universe.agg(F.approx_count_distinct("key")).first()[0]  # for the first level's rate only
    levels = {}
    for i, action in enumerate(("block", "allow")):
        listed = rules.where(F.col("action") == action).select(F.col("rule").alias("key")).distinct()
        levels[action] = cascade(listed, sizes.get(action, 0), universe, size, 100_000 * i)
    ranked = F.filter(
        F.transform(F.col(keys), lambda k: F.struct(
            F.length(k).alias("chars"), (F.instr(k, "/")).alias("host_chars"), k.alias("rule"),
            F.when(is_listed(levels["block"], k), "block").when(is_listed(levels["allow"], k), "allow").alias("action"),
        )), lambda r: r["action"].isNotNull(),
    )
    out = out.withColumn(keys, candidates).withColumn(best, F.array_max(ranked))
    return out.withColumns({"rule": F.col(best)["rule"], "verdict": F.coalesce(F.col(best)["action"], F.lit(default))}).drop(labels, keys, best)
