"""Phrase collocations from a weighted de Bruijn graph of words.

The texts give one table of counts: the longest gram that starts at every word. A gram of full length is an edge between the two overlapping shorter grams
(nodes) that it consists of, weighted with its count; a shorter one ends its piece and is kept as a correction. All other counts follow without
another look at the texts: a node occurs as often as its outgoing edges and the pieces that end in it, and the same holds one length below. So every word
position is shuffled once, whatever the number of lengths: tasks count the grams of some megabytes of text, and send them packed by buckets of nodes. All
edges out of a node lie in one bucket, so its flow needs no shuffle of its own, and only what is frequent and the counts of words leave a bucket.

Nodes with one edge in, one edge out and one weight have no piece that starts or ends in them. Chains of them (unary paths: passages that always occur whole)
are compacted to one row, found by pointer doubling. A path lies within every piece that touches it, so no path is longer than the longest piece. Inside a
path all grams have its weight, hence a shorter candidate there always lies in an equally frequent longer one and goes, and only the ends of paths meet the
counts of nodes again.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.llm.common import ascii_lower
from gridpanel.llm.shingles import mix
from gridpanel.session import written

LONGEST = 3
TOKENS = 1 << 20  # words and piece ends that a task counts at once
BUCKETS = 8  # of nodes, for each input partition: a bucket holds the grams of some 20 MB of text and is reduced in memory
SALTS = (1024, 32)  # parts of a language in which the best phrases are chosen before they meet
# words, and piece ends (one for a run of them)
_TOKEN = re.compile("[^ \t.,;:!?\n\x0b\x0c\r]+|[.,;:!?\n\x0b\x0c\r]+")
_ENDS = frozenset(".,;:!?\n\x0b\x0c\r")
WORD, NODE, EDGE = 0, 1, 2  # kinds of counts


class _Chunk:
    """Words and piece ends of texts, numbered for each language."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.next = count()
        self.numbers: dict[str, defaultdict] = {}
        self.parts: list[np.ndarray] = []
        self.left_out: list[int] = []  # places whose grams are counted elsewhere
        self.size = 0

    def add(self, lang: str, tokens: list[str], goes_on: bool = False) -> None:
        """Take the tokens of a text or of a part of it; the next part repeats the last two tokens, and counts the grams that start there."""
        numbers = self.numbers.get(lang)
        if numbers is None:
            numbers = self.numbers[lang] = defaultdict(self.next.__next__)
        self.parts.append(np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens)))
        self.size += len(tokens)
        if goes_on:
            self.left_out += [self.size - 2, self.size - 1]

    def counted(self) -> Iterator[pa.RecordBatch]:
        """(bucket, lang, lines): the longest gram at each word with its count, a line each; words and counts are parted by tabs."""
        ids = np.concatenate([*self.parts, [-1, -1]]) if self.parts else np.zeros(0, np.int64)
        n = next(self.next)
        words, langs = np.empty(n, object), np.empty(n, np.int32)
        names = list(self.numbers)
        for k, lang in enumerate(names):
            at = np.fromiter(self.numbers[lang].values(), np.int64, len(self.numbers[lang]))
            words[at], langs[at] = list(self.numbers[lang]), k
        left_out = self.left_out
        self.clear()
        if not n:
            return
        end = np.fromiter((w[0] in _ENDS for w in words), bool, n)
        ids[:-2][end[ids[:-2]]] = -1
        first, second, third = ids[:-2], ids[1:-1], ids[2:]
        third = np.where(second < 0, -1, third)
        keep = first >= 0
        keep[left_out] = False
        packed, c = np.unique((first[keep] << 42) | (second[keep] + 1 << 21) | (third[keep] + 1), return_counts=True)
        low = (1 << 21) - 1
        grams = (packed >> 42, (packed >> 21 & low) - 1, (packed & low) - 1)
        hashes = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, n)
        second_hash = np.where(grams[1] >= 0, hashes[grams[1]], np.uint64(1 << 40))
        bucket = (mix(hashes[grams[0]] << np.uint64(32) ^ second_hash) % np.uint64(self.buckets)).astype(np.int64)
        group = bucket * len(names) + langs[grams[0]]
        order = np.argsort(group, kind="stable")
        table = pa.array([*words, ""], pa.string())
        columns = [table.take(pa.array(np.where(g < 0, n, g)[order])) for g in grams]
        lines = pc.binary_join_element_wise(*columns, pa.array(c[order]).cast(pa.string()), "\t")
        group = group[order]
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(group)).astype(np.int32)), lines)
        at = group[starts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at // len(names)), pa.array(names, pa.string()).take(pa.array(at % len(names))), pc.binary_join(lists, "\n")], names=["bucket", "lang", "lines"])


def _count_grams(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk(buckets)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if len(text) < TOKENS:
                    chunk.add(lang, [*_TOKEN.findall(text), "."])
                else:
                    found = (m.group() for m in _TOKEN.finditer(text))
                    tokens = list(islice(found, TOKENS // 2))
                    while following := list(islice(found, TOKENS // 2)):
                        chunk.add(lang, tokens, goes_on=True)
                        if chunk.size >= TOKENS:
                            yield from chunk.counted()
                        tokens = tokens[-2:] + following
                    chunk.add(lang, [*tokens, "."])
                if chunk.size >= TOKENS:
                    yield from chunk.counted()
        yield from chunk.counted()

    return run


def _sums(table: pa.Table, keys: list[str], sums: list[str]) -> pa.Table:
    out = table.group_by(keys, use_threads=False).aggregate([(c, "sum") for c in sums])
    return out.select([*keys, *[f"{c}_sum" for c in sums]]).rename_columns([*keys, *sums])


def _reduce_bucket(least: int):
    """Counts of a bucket: the words' shares, and the nodes and edges that occur ``least`` times, with the number of edges out of a node."""
    def run(table: pa.Table) -> pa.Table:
        lines = pc.split_pattern(table.column("lines").combine_chunks(), "\n")
        lang = table.column("lang").combine_chunks().take(pc.list_parent_indices(lines))
        fields = pc.split_pattern(lines.flatten(), "\t").flatten()
        w1, w2, w3, c = (fields.take(pa.array(np.arange(i, len(fields), 4))) for i in range(4))
        grams = _sums(pa.table({"lang": lang, "w1": w1, "w2": w2, "w3": w3, "c": c.cast(pa.int64())}), ["lang", "w1", "w2", "w3"], ["c"])
        ends = pc.equal(grams.column("w3"), "")
        nodes = grams.append_column("outs", pc.if_else(ends, 0, 1)).append_column("end", pc.if_else(ends, grams.column("c"), 0))
        nodes = _sums(nodes, ["lang", "w1", "w2"], ["c", "outs", "end"])
        words = _sums(nodes, ["lang", "w1"], ["c"])
        nodes = nodes.filter(pc.and_(pc.not_equal(nodes.column("w2"), ""), pc.greater_equal(nodes.column("c"), least)))
        edges = grams.filter(pc.and_(pc.invert(ends), pc.greater_equal(grams.column("c"), least)))
        out = []
        for kind, part, keys in ((WORD, words, ["w1"]), (NODE, nodes, ["w1", "w2"]), (EDGE, edges, ["w1", "w2", "w3"])):
            gram = part.column(keys[0]) if len(keys) == 1 else pc.binary_join_element_wise(*[part.column(k) for k in keys], " ")
            single = pc.and_(pc.equal(part.column("outs"), 1), pc.equal(part.column("end"), 0)) if kind == NODE else pa.nulls(len(part), pa.bool_())
            out.append(pa.table({"kind": pa.array(np.full(len(part), kind, np.int32)), "lang": part.column("lang"), "gram": gram, "c": part.column("c"), "single": single}))
        return pa.concat_tables(out)

    return run


def grams(docs: DataFrame, least: int) -> DataFrame:
    """(kind, lang, gram, c, single): parts of the counts of all words, and the counts of the nodes and edges that occur ``least`` times.

    ``single`` tells that one edge leaves a node, and that no piece ends in it.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), ascii_lower(F.coalesce("text", F.lit(""))).alias("text"))
    buckets = BUCKETS * max(1, rows.rdd.getNumPartitions())  # grows with the table
    packed = rows.mapInArrow(_count_grams(buckets), "bucket bigint, lang string, lines string")
    return packed.groupBy("bucket").applyInArrow(_reduce_bucket(least), "kind int, lang string, gram string, c bigint, single boolean")


def _first(gram: Column | str, n: int) -> Column:
    return F.substring_index(gram, " ", n)


def _last(gram: Column | str, n: int) -> Column:
    return F.substring_index(gram, " ", -n)


def unary_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(lang, node, f, single)`` with unary: one edge out, and one in that has the whole weight, so that nothing starts or ends in the node."""
    into = edges.groupBy("lang", _last("gram", 2).alias("node")).agg(F.max("c").alias("most"))
    return nodes.join(into, ["lang", "node"], "left").select("lang", "node", "f", (F.col("single") & F.coalesce(F.col("most") == F.col("f"), F.lit(False))).alias("unary"))


def paths(edges: DataFrame, unary: DataFrame) -> DataFrame:
    """(lang, words, weight): ``edges(lang, gram, c)`` with the chains through ``unary(lang, node)`` compacted.

    Every edge knows the edge behind it if the node between is unary. Doubling gives each its distance to the end of its chain, and the last edge names
    the path. The number of rounds is the logarithm of the longest chain.
    """
    inner = unary.select("lang", F.col("node").alias("via"))
    ahead = edges.select("lang", _first("gram", 2).alias("via"), F.col("gram").alias("next")).join(inner, ["lang", "via"])
    state = edges.select("lang", "gram", "c", _last("gram", 2).alias("via")).join(ahead, ["lang", "via"], "left").select(
        "lang", "gram", "c", F.coalesce("next", "gram").alias("to"), F.col("next").isNotNull().cast("long").alias("steps"))
    state = written(state)
    while True:
        jump = state.where("steps > 0").select("lang", F.col("gram").alias("to"), F.col("to").alias("then"), F.col("steps").alias("more"))
        if jump.isEmpty():
            break
        now = written(state.join(jump, ["lang", "to"], "left").select(
            "lang", "gram", "c", F.coalesce("then", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
        moved = now.agg(F.sum("steps")).first()[0]
        if moved == state.agg(F.sum("steps")).first()[0]:
            break
        state = now
    # the words of a path: the first of every edge, and the last edge whole; at most a piece long
    chain = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("steps", "gram")))), lambda s: s["gram"])
    chains = state.groupBy("lang", "to").agg(chain.alias("chain"), F.max("c").alias("weight"))
    spelled = F.concat(F.transform("chain", lambda g: _first(g, 1)), F.split(_last("to", 2), " "))
    return chains.select("lang", spelled.alias("words"), "weight")


def _cut_score(a: Column, left: Column, right: Column) -> Column:
    # decimals of 38 digits, divided as integers: exact
    wide = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * a.cast("decimal(15,0)") * a.cast("decimal(15,0)"), wide(left) * wide(right))


def _window(w: Column, i: Column, n: int) -> Column:
    return F.concat_ws(" ", *[F.get(w, i + j) for j in range(n)])


def candidates(docs: DataFrame, least: int = 10, within: int = 50) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases of two and three words that occur ``least`` times and do not mostly occur in a longer one.

    A phrase goes if a longer candidate that holds it has at least ``within`` hundredths of its count.
    """
    counts = written(grams(docs, least))
    singles = written(counts.where(F.col("kind") == WORD).groupBy("lang", F.col("gram").alias("word")).agg(F.sum("c").alias("f")))
    totals = singles.groupBy("lang").agg(F.sum("f").alias("n"))
    edges = counts.where(F.col("kind") == EDGE).select("lang", "gram", "c")
    heavy = written(unary_nodes(counts.where(F.col("kind") == NODE).select("lang", F.col("gram").alias("node"), F.col("c").alias("f"), "single"), edges))
    graph = written(paths(edges, heavy.where("unary").select("lang", "node")))
    # edges of the paths, with the counts of their nodes where these lie inside a path
    last = F.size("words") - 3
    at = F.explode(F.sequence(F.lit(0), last)).alias("i")
    each = graph.select("lang", "words", "weight", at, last.alias("last")).select(
        "lang", _window(F.col("words"), F.col("i"), 3).alias("phrase"), F.col("weight").alias("a"), (F.col("i") > 0).alias("left_inner"), (F.col("i") < F.col("last")).alias("right_inner"))
    # ends of paths: their nodes, and the heaviest edge at each
    tips = graph.select("lang", "weight", F.explode(F.array(_window(F.col("words"), F.lit(0), 2), _window(F.col("words"), last + 1, 2))).alias("node"))
    heaviest = tips.groupBy("lang", "node").agg(F.max("weight").alias("longer"))
    ends = written(heavy.where("not unary").join(heaviest, ["lang", "node"], "left").select("lang", "node", "f", F.coalesce("longer", F.lit(0)).alias("longer")))
    two = ends.where(100 * F.col("longer") < within * F.col("f")).select("lang", F.col("node").alias("phrase"), F.col("f").alias("a"))
    node = lambda side: ends.select("lang", F.col("node").alias(side), F.col("f").alias(f"f_{side}"))
    three = each.withColumn("p", F.when(~F.col("left_inner"), _first("phrase", 2))).withColumn("q", F.when(~F.col("right_inner"), _last("phrase", 2)))
    three = three.join(node("p"), ["lang", "p"], "left").join(node("q"), ["lang", "q"], "left").select(
        "lang", "phrase", "a", F.coalesce("f_p", "a").alias("f_p"), F.coalesce("f_q", "a").alias("f_q"))
    every = written(three.unionByName(two.select("lang", "phrase", "a", F.lit(None).cast("long").alias("f_p"), F.lit(None).cast("long").alias("f_q"))))
    used = every.select("lang", F.explode(F.array(_first("phrase", 1), _last("phrase", 1))).alias("word")).distinct()
    singles = written(singles.join(used, ["lang", "word"]))

    def with_word(rows: DataFrame, word: Column, out: str) -> DataFrame:
        # frequent words hold many phrases: their rows are spread over the tasks
        salted = rows.select("*", word.alias("word"), F.pmod(F.xxhash64("phrase"), F.lit(8)).alias("salt"))
        copies = singles.select("lang", "word", F.col("f").alias(out), F.explode(F.array(*[F.lit(i).cast("long") for i in range(8)])).alias("salt"))
        return salted.join(copies, ["lang", "word", "salt"]).drop("word", "salt")

    rows = with_word(with_word(every, _first("phrase", 1), "f_first"), _last("phrase", 1), "f_last")
    early, late = (F.col("f_first"), F.coalesce("f_q", "f_last")), (F.col("f_p"), F.col("f_last"))
    rows = rows.withColumn("s1", _cut_score(F.col("a"), *early)).withColumn("s2", F.when(F.col("f_p").isNotNull(), _cut_score(F.col("a"), *late)))
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    rows = rows.select("lang", "phrase", "a", F.when(second, late[0]).otherwise(early[0]).alias("l"), F.when(second, late[1]).otherwise(early[1]).alias("r"),
                       F.when(second, F.col("s2")).otherwise(F.col("s1")).alias("score"))
    return rows.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, least: int = 10, within: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the first ``top`` phrases of each language by score and count, falling, then by phrase.

    Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends and into words at blanks and tabs. A null text is empty, a null lang is ``und``
    and one with rows of that name, repeated rows count each, extra columns are ignored; a language without candidates has no rows.
    """
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = candidates(docs, least, within).withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS[0])))
    for parts in (*SALTS, 1):  # a part hands on its first rows: no task sorts a whole language
        rows = rows.withColumn("_salt", F.pmod("_salt", F.lit(parts)))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
