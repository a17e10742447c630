"""Benchmark decontamination by canonical templates.

Texts become token templates: numbers, names and units turn into typed placeholders, other words are lower-cased and punctuation is dropped.
Windows of five template tokens are joined with those of the benchmark by hash (a bit table of the benchmark's windows keeps the
rest of the corpus out of the join), and the slots of matched windows are checked: one value of the item must stand for one value in the
document throughout, and two names of the item for two names (two numbers may become equal by chance). So verbatim copies and re-parameterised questions are found alike.

A text has three readings: plain (no names), with the sure names (capitalised words inside a sentence, and the benchmark's name words wherever and however
they are written), and with every capitalised word as a name. Windows of all three are joined, windows of an item with its doubtful capitals both as
words and as names; the coverages of the readings are united. A name that is replaced and has lost its capital as well is not known for a name.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.llm.common import fresh
from gridpanel.llm.url_filter import Bloom, build_bloom
from gridpanel.session import written

WIDTH, COVERAGE = 5, 0.8
# Bits of the table for a benchmark window, and of the whole table at most: with more windows it lets more through to the join, which stays exact.
WINDOW_BITS, TABLE_BITS = 256, 1 << 27
# Words that count as a unit right after a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars cent cents euro euros percent degree degrees watt watts volt volts"
)
# Placeholder tokens: the two circled letters never survive in a canonical text, the private-use marks stand before names and other capitalised words.
NUMBER, UNIT, NAME, CAPITAL = "ⓝ", "ⓤ", "\ue000", "\ue001"
# The first character stands before the lookbehind, so that most positions fail at once.
_DECIMAL = r"[.,](?<=\p{N}[.,])(?=\p{N})"
_NAME = r"\p{Lu}(?<=[\p{Ll},;] \p{Lu})[\p{Ll}\p{M}]+(?![\p{L}\p{M}\p{N}])"
_CAPITAL = rf"\p{{Lu}}(?<![\p{{L}}\p{{M}}\p{{N}}{NAME}]\p{{Lu}})[\p{{Ll}}\p{{M}}]+(?![\p{{L}}\p{{M}}\p{{N}}])"
_GAP = rf"[^\p{{L}}\p{{M}}\p{{N}}·{NAME}{CAPITAL}]+"
_NUMBER = r"\p{N}(?<![^ ]\p{N})[\p{N}·]*(?![^ ])"
_UNIT = rf"{NUMBER} {CAPITAL}?(?:{UNITS.replace(' ', '|')})(?![^ ])"


def _swap(text: Column, by: str) -> Column:
    return F.replace(F.replace(text, F.lit(NAME), F.lit(by)), F.lit(CAPITAL), F.lit(by))


def _unmarked(word: Column) -> Column:
    return _swap(word, "")


def _tokens(rows: DataFrame) -> DataFrame:
    """Replace ``text`` by arrays of one length: r, the lower-cased words; t, with placeholders for numbers and units and marks before capitals; p, t without marks."""
    clean = F.regexp_replace(_swap(F.col("text"), " "), _DECIMAL, "·")
    marked = F.regexp_replace(F.regexp_replace(clean, _NAME, NAME + "$0"), _CAPITAL, CAPITAL + "$0")
    rows = rows.withColumn("text", F.trim(F.regexp_replace(F.lower(marked), _GAP, " ")))
    rows = rows.withColumn("t", F.regexp_replace(F.regexp_replace("text", _NUMBER, NUMBER), _UNIT, f"{NUMBER} {UNIT}"))
    cut = {"r": _unmarked(F.col("text")), "t": F.col("t"), "p": _unmarked(F.col("t"))}
    return rows.withColumns({k: F.split(c, " ") for k, c in cut.items()}).drop("text")


def _readings(words: DataFrame, names: Bloom | None) -> DataFrame:
    """Columns s and n beside p, the readings of the template ``t``; ``names`` tells the name words (wrong hits are names on both sides, which loses nothing)."""
    sure = F.zip_with("t", "p", lambda w, v: F.when(F.startswith(w, F.lit(NAME)) | (names.holds(F.xxhash64(v)) if names else F.lit(False)), NAME).otherwise(v))
    words = words.withColumn("s", sure)
    return words.withColumn("n", F.zip_with("t", "s", lambda w, v: F.when(F.startswith(w, F.lit(CAPITAL)), NAME).otherwise(v)))


def _window_hash(hashes: Column, at: Column, width: int) -> Column:
    """Hash of a window from the hashes of its tokens."""
    return F.xxhash64(*[F.get(hashes, at + i) for i in range(width)])


def _token_hashes(words: DataFrame, names: Bloom | None) -> DataFrame:
    """Columns hp, hs and hn: hashes of the tokens of the three readings, without the readings themselves."""
    name = F.xxhash64(F.lit(NAME))
    words = words.withColumn("hp", F.transform("p", lambda v: F.xxhash64(v)))
    words = words.withColumn("hs", F.zip_with("t", "hp", lambda w, h: F.when(F.startswith(w, F.lit(NAME)) | (names.holds(h) if names else F.lit(False)), name).otherwise(h)))
    return words.withColumn("hn", F.zip_with("t", "hs", lambda w, h: F.when(F.startswith(w, F.lit(CAPITAL)), name).otherwise(h)))


def _is_slot(word: Column) -> Column:
    return word.isin(NUMBER, NAME, UNIT)


def _windows(tokens: DataFrame, tables: dict[int, Bloom], names: Bloom | None) -> DataFrame:
    """The windows of any reading that the bit tables let through: pos, and up to five tokens of t, p and r from there.

    Positions are exploded and tested on hashes inside one generated stage; the outer form keeps the planner from finding the arrays' sizes by a
    second tokenising pass.
    """
    at = _token_hashes(tokens, names).select("*", F.posexplode_outer("hp").alias("pos", "word"))
    tests = [
        (F.size("hp") >= F.col("pos") + width) & reduce(or_, [table.holds(_window_hash(F.col(c), F.col("pos"), width)) for c in ("hp", "hs", "hn")])
        for width, table in tables.items()
    ]
    return at.where(reduce(or_, tests)).select("doc_id", "mark", "pos", *[F.slice(c, F.col("pos") + 1, WIDTH).alias(c) for c in "tpr"])


def name_words(benchmark: DataFrame) -> DataFrame:
    """word: capitalised inside a sentence of the benchmark, and never lower-case there."""
    words = benchmark.where(F.col("item_id").isNotNull()).select(F.coalesce("text", F.lit("")).alias("text"))
    words = _tokens(words).select(F.explode("t").alias("w"))
    return words.groupBy(_unmarked(F.col("w")).alias("word")).agg(
        F.bool_or(F.startswith("w", F.lit(NAME))).alias("name"), F.bool_or(~F.col("w").rlike(f"^[{NAME}{CAPITAL}]")).alias("lower"),
    ).where("name and not lower").select("word")


def benchmark_windows(benchmark: DataFrame, names: Bloom | None) -> DataFrame:
    """item, at, width, words, tokens, loose and total windows of an item; an item shorter than a window is one window, an empty one has none.

    A window has a row for its plain reading and one for each choice of its doubtful capitals as words or names; ``loose`` flags those taken as names.
    """
    words = _tokens(benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").alias("item"), F.coalesce("text", F.lit("")).alias("text")))
    words = _readings(words.where(F.get("t", F.lit(0)) != "").distinct(), names)
    width = F.least(F.lit(WIDTH), F.size("t"))
    part = lambda c: F.slice(c, F.col("at") + 1, F.col("width")).alias(c)
    cut = words.withColumn("total", F.size("t") - width + 1).select(
        "item", "total", "p", "s", "n", "r", F.explode(F.sequence(F.lit(0), F.col("total") - 1)).alias("at"), width.alias("width"),
    ).select("item", "at", "width", "total", part("p"), part("s"), part("n"), part("r"))
    doubtful = F.zip_with("s", "n", lambda a, b: a != b)
    bits = F.filter(F.transform(doubtful, lambda d, i: F.when(d, F.pow(F.lit(2.0), i)).otherwise(0.0).cast("int")), lambda b: b > 0)
    masks = F.aggregate(bits, F.array(F.lit(0)), lambda m, b: F.concat(m, F.transform(m, lambda x: x + b)))  # 32 at most
    loose = F.transform("s", lambda w, i: F.pmod(F.floor(F.col("mask") / F.pow(F.lit(2), i)), F.lit(2)) == 1)
    chosen = cut.withColumn("mask", F.explode(masks)).withColumn("loose", loose).withColumn("words", F.zip_with("s", "loose", lambda w, x: F.when(x, NAME).otherwise(w)))
    plain = cut.withColumn("loose", F.transform("p", lambda w: F.lit(False))).withColumn("words", F.col("p"))
    columns = ["item", "at", "width", "total", "words", F.col("r").alias("tokens"), "loose"]
    return chosen.select(*columns).unionByName(plain.select(*columns)).distinct()


def _mark(text: Column) -> Column:
    return F.xxhash64(text)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each (doc_id, mark, item) that share windows: coverage, the share of the item's windows with consistent slots in the document.

    A document is a doc_id with a text, of which ``mark`` is a hash: rows that repeat both are one document, rows with a null or repeated id and other
    texts are not. Null and empty texts share nothing; item ids that are null are ignored. Replaced capitals of an item that may be plain words count
    only beside a window of the same run without such a replacement.
    """
    schema = "doc_id bigint, mark bigint, item bigint, coverage double"
    listed = written(name_words(benchmark).select(F.xxhash64("word").alias("key")))
    n = listed.count()
    names = build_bloom(listed, n, 0.5, 3, bits=min(WINDOW_BITS * n, TABLE_BITS)) if n else None
    items = written(benchmark_windows(benchmark, names))
    keys = {w: n for w, n in items.groupBy("width").agg(F.countDistinct("words").alias("n")).collect()}  # five widths at most
    if not keys:
        return docs.sparkSession.createDataFrame([], schema)
    tables = {}
    for width, n in sorted(keys.items()):
        mine = items.where(F.col("width") == width).select(_window_hash(F.transform("words", lambda v: F.xxhash64(v)), F.lit(0), width).alias("key")).distinct()
        tables[width] = build_bloom(mine, n, 0.5, 7 * width, bits=min(WINDOW_BITS * n, TABLE_BITS))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", _mark(F.col("text")).alias("mark"), "text")
    found = _readings(_windows(_tokens(texts), tables, names), names)
    # every reading and width of a hit is joined, which is exact
    readings = [F.when(F.size("p") >= w, F.slice(c, 1, w)) for w in tables for c in "psn"]
    hits = found.withColumn("words", F.explode(F.array_distinct(F.array_compact(F.array(*readings)))))
    pairs = hits.join(items, "words")
    # the readings in which the window reads like this
    alike = F.posexplode(F.array(*[F.slice(c, 1, F.col("width")) == F.col("words") for c in "psn"])).alias("reading", "alike")
    pairs = pairs.select("doc_id", "mark", "pos", "words", "item", "at", "total", "tokens", "loose", F.slice("r", 1, F.col("width")).alias("found"), alike).where("alike")
    slot = F.zip_with("tokens", "found", lambda a, b: F.struct(a.alias("item"), b.alias("doc")))
    pairs = pairs.withColumn("slot", F.arrays_zip(F.col("words").alias("w"), F.col("loose").alias("l"), slot.alias("s")))
    values = lambda test: F.transform(F.filter("slot", lambda x: test(x["w"])), lambda x: x["s"])
    kept = F.forall("slot", lambda x: ~x["l"] | (x["s"]["item"] == x["s"]["doc"]))
    united = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))  # noqa: E731 - bounded by the item's windows
    runs = pairs.groupBy("doc_id", "mark", "item", "total", "reading", (F.col("pos") - F.col("at")).alias("shift")).agg(
        F.bool_or(kept).alias("kept"), F.collect_set("at").alias("ats"), united(values(_is_slot)).alias("slots"), united(values(lambda w: w == NAME)).alias("named"))
    one = lambda c, side: F.size(F.array_distinct(F.transform(c, lambda s: s[side]))) == F.size(c)
    share = F.size(F.array_distinct(F.flatten(F.collect_set("ats")))) / F.col("total")
    good = runs.where(one("slots", "item") & one("named", "doc") & F.col("kept"))
    return good.groupBy("doc_id", "mark", "item", "total").agg(share.alias("coverage")).drop("total")


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_id (smallest of those with the largest coverage) and coverage for every row of ``docs``."""
    bad = leaks(docs, benchmark).where(F.col("coverage") >= COVERAGE)
    best = bad.groupBy("doc_id", "mark").agg(F.count("*").alias("n_items"), F.max(F.struct("coverage", (-F.col("item")).alias("m"))).alias("best"))
    best = best.withColumnsRenamed({"doc_id": "id_", "mark": "mark_"})
    mine = docs.select("doc_id", _mark(F.col("text")).alias("mark"))
    return mine.join(best, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("mark") == F.col("mark_")), "left").select(
        "doc_id", F.col("best").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        (-F.col("best.m")).alias("item_id"), F.coalesce("best.coverage", F.lit(0.0)).alias("coverage"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    mine, mark = fresh("doc", "mark")
    bad = written(leaks(docs, benchmark).where(F.col("coverage") >= COVERAGE).select(F.col("doc_id").alias(mine), F.col("mark").alias(mark)).distinct())
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(mine)) & (_mark(F.col("text")) == F.col(mark)), "left_anti")
