"""Exact duplicates by a distributed MSD radix partition.

Documents are split by their byte length and then by successive digits of their bytes, until a group is a singleton or its texts have ended;
texts in one ended group are equal byte by byte, so no digest decides. A digit is a run of bytes whose width grows eightfold from round to
round, so that the rounds are logarithmic in the longest text. Each round counts (group, digit) with map-side aggregation and hands the new
group down by a merge join, whatever the size (adaptive plans split it where a group is hot); only documents in unfinished groups move again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.llm.common import ascii_lower, fresh
from gridpanel.llm.url_filter import FILTER_BITS, build_bloom
from gridpanel.session import release, written

FIRST_DIGIT, GROWTH = 64, 8


def _bytes(text):
    return ascii_lower(text).cast("binary")


def _sha256(text):
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest doc_id of a group stays; of repeated
    rows with that id exactly one stays. A null doc_id is smaller than any other. Extra columns are ignored; an empty table gives an empty one.
    """
    return _groups(docs)[0]


def _groups(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``exact_groups``, and the tables that it reads."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", text.alias("text"), _sha256(F.col("text")).alias("text_sha256"),
        F.octet_length(text).cast("long").alias("size"), F.substring(_bytes(F.substring(text, 1, FIRST_DIGIT)), 1, FIRST_DIGIT).alias("digit"),
    )
    shared = rows.groupBy("size", "digit").agg(F.count("*").alias("n")).where("n > 1").select("size", "digit", F.monotonically_increasing_id().alias("node"))
    names = ["doc_id", "text_sha256"]
    # ids of nodes and rows are fixed by writing them
    shared = written(shared)
    rows = rows.join(shared.hint("merge"), ["size", "digit"], "left")
    state = written(rows.select(*names, "size", "node", F.when(F.col("node").isNotNull(), F.col("text")).alias("text"),
                                F.monotonically_increasing_id().alias("tag")))
    release(shared)
    used, alone = [state], F.col("node").isNull()
    done = [state.where(alone).select(*names, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))]
    state, start, end = state.where(~alone), FIRST_DIGIT, FIRST_DIGIT * GROWTH * 2
    while not state.isEmpty():
        digit = F.substring(_bytes(F.col("text")), start + 1, end - start)
        rows = state.withColumn("digit", digit)
        groups = rows.groupBy("node", "digit").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "tag")).alias("top"))
        groups = written(groups.select("node", "digit", "n", "top", F.monotonically_increasing_id().alias("child")))
        joined = rows.join(groups.hint("merge"), ["node", "digit"])
        still = (F.col("n") > 1) & (F.col("size") > end)
        state = written(joined.select(*names, "size", "tag", "n", "top", F.when(still, F.col("child")).alias("node"),
                                      F.when(still, F.col("text")).alias("text")))
        release(groups)
        used.append(state)
        ended = state.where(F.col("node").isNull())
        done.append(ended.select(*names, F.col("top.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("tag") == F.col("top.tag")).alias("kept")))
        state, start, end = state.where(F.col("node").isNotNull()).drop("n", "top"), end, end * GROWTH
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out, used


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns.

    What goes is written as ids with the SHA-256 of their texts, so no text stays on disk behind the result; rows that repeat an id and a text are one.
    A bit table of the ids tells most rows that stay without a join, so that their texts are not shuffled.
    """
    found, used = _groups(docs)
    mine, digest, copies, stays, sha = fresh("doc", "digest", "copies", "stays", "sha")
    several = found.where("group_size > 1").groupBy(F.col("doc_id").alias(mine), F.col("text_sha256").alias(digest))
    gone = written(several.agg(F.count("*").alias(copies), F.max("kept").alias(stays)).where(~F.col(stays) | (F.col(copies) > 1)))
    release(*used)
    n = gone.count()
    if not n:
        return docs
    named = build_bloom(gone.select(F.col(mine).alias("key")), n, 0.5, 17, bits=min(16 * n + 64, FILTER_BITS)).holds(F.col("doc_id"))
    rows = docs.where(named).withColumn(sha, _sha256(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col(mine)) & (F.col(sha) == F.col(digest))
    out, repeated = rows.join(gone, same, "left_anti"), gone.where(F.col(stays))
    if not repeated.isEmpty():
        out = out.unionByName(rows.join(repeated, same, "left_semi").dropDuplicates(["doc_id", sha]))
    return docs.where(~named).unionByName(out.drop(sha))
