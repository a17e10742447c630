"""Column helpers that several text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; the fast built-in serves texts that are pure ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of words (``WORD``); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(*names: str) -> list[str]:
    """Column names that cannot clash with those of the input."""
    tag = uuid.uuid4().hex[:8]
    return [f"_{n}_{tag}" for n in names]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with about ``limit`` bytes of ``column``, so that a task works on few texts at a time; a longer text is a part of its own."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if size and size + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for the rows that a model must not learn from: crc32 of the id as text; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def bounded_sample(rows: DataFrame, by: list[str], bound: int, salt: int = 0) -> DataFrame:
    """About ``bound`` rows of each group of ``by`` (all of a smaller group), drawn by a hash of ``doc_id``: reruns agree."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(salt)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    return rows.join(F.broadcast(sizes), by).where(share < F.lit(float(bound)) / F.col("_n")).drop("_n")
