"""Readers: projected scans, mappings, flagged statistical tables, registered sources and draw folders."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def project(df: DataFrame, keep: Sequence[str], patterns: Sequence[str] = (), renames: dict | None = None) -> DataFrame:
    """Keep named columns plus those matching a pattern, then rename; Catalyst prunes the rest at the scan."""
    wanted = [c for c in df.columns if c in keep or any(re.search(p, c) for p in patterns)]
    missing = [c for c in keep if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in source: {missing}")
    return df.select(*wanted).withColumnsRenamed(renames or {})


def scan(
    spark: SparkSession, path: str, keep: Sequence[str] = (), patterns: Sequence[str] = (), renames: dict | None = None
) -> DataFrame:
    df = spark.read.parquet(path)
    return project(df, keep, patterns, renames) if keep or patterns else df


def read_mapping(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read a thematic mapping: quoted fields may hold commas; blank fields become NULL."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def parse_flagged(col) -> object:
    """Number before the first blank; flag letters are dropped and ':' means missing."""
    text = F.trim(col.cast("string"))
    return F.regexp_replace(text, r"\s.*$", "").try_cast("double")


def read_flagged_table(df: DataFrame) -> DataFrame:
    """Tidy a wide statistical extract: composite key column, one column per year, flagged values.

    The first column is named ``dim1,dim2,...\\TIME`` and holds comma-joined dimension values.
    """
    key = df.columns[0]
    dims = [d.strip() for d in key.split("\\")[0].split(",")]
    years = [c for c in df.columns[1:] if re.fullmatch(r"[12]\d{3}", c.strip())]
    parts = F.split(F.col(f"`{key}`"), ",")
    wide = df.select(
        *[F.trim(F.get(parts, F.lit(i))).alias(d) for i, d in enumerate(dims)],
        *[F.col(f"`{y}`").cast("string").alias(y.strip()) for y in years],
    )
    long = wide.unpivot(dims, [y.strip() for y in years], "year", "flagged")
    return long.select(*dims, F.col("year").cast("int").alias("year"), parse_flagged(F.col("flagged")).alias("value"))


def read_flagged_tsv(spark: SparkSession, path: str) -> DataFrame:
    return read_flagged_table(spark.read.option("header", True).option("sep", "\t").csv(path))


@dataclass(frozen=True)
class SourceEntry:
    """Where one (lineage, year) of the land-cover map lives and what its columns are called."""

    path: str
    id_col: str
    code_col: str
    area_col: str


def normalise_source(df: DataFrame, entry: SourceEntry) -> DataFrame:
    """Rename to ``(join_id, code, area)`` and keep positive areas; the filter reaches the scan."""
    need = [entry.id_col, entry.code_col, entry.area_col]
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"{entry.path}: required columns missing: {missing}")
    return df.select(
        F.col(entry.id_col).cast("long").alias("join_id"),
        F.col(entry.code_col).alias("code"),
        F.col(entry.area_col).cast("double").alias("area"),
    ).where(F.col("area") > 0)


class SourceRegistry:
    """Registered land-cover sources by (lineage, year)."""

    def __init__(self, entries: dict[tuple[str, int], SourceEntry]):
        self._entries = dict(entries)

    def years(self, lineage: str) -> list[int]:
        return sorted(y for name, y in self._entries if name == lineage)

    def entry(self, lineage: str, year: int) -> SourceEntry:
        try:
            return self._entries[(lineage, year)]
        except KeyError:
            raise KeyError(f"no source for {lineage} {year}; have {self.years(lineage)}") from None

    def load(self, spark: SparkSession, lineage: str, year: int) -> DataFrame:
        entry = self.entry(lineage, year)
        return normalise_source(spark.read.parquet(entry.path), entry)


def read_draws(spark: SparkSession, path: str, chains: Sequence[int] | None = None) -> DataFrame:
    """All draw batches under ``path`` (partitioned by chain and batch); ``chains`` prunes partitions."""
    df = spark.read.parquet(path)
    if chains is not None:
        df = df.where(F.col("chain").isin(*chains))
    return df.withColumn("batch", F.col("batch").cast("long"))
