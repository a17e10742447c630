"""Sinks: partitioned Parquet, CSV, a table with its metadata, and the raster table."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()
) -> None:
    """Write Parquet or CSV.  Partition columns are clustered first so that tasks do not each open every folder."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown format {fmt!r}")
    out = df
    if partition_by:
        # a rebalance splits a hot partition value over several tasks and merges small ones
        out = df.hint("rebalance", *partition_by)
    writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def write_with_metadata(df: DataFrame, path: str, metadata: dict, **kwargs) -> None:
    """Write a table and, beside it, a one-row JSON table with column order and run metadata."""
    write_table(df, f"{path}/data", **kwargs)
    body = json.dumps({"columns": df.columns, **metadata}, sort_keys=True)
    spark = df.sparkSession
    spark.range(1).select(F.lit(body).alias("value")).write.mode("overwrite").text(f"{path}/metadata")


def read_metadata(spark, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/metadata").first()["value"])


def raster_table(df: DataFrame, coord: Sequence[str], cls: str, area: str, slice_cols: Sequence[str] = ()) -> DataFrame:
    """Merge region fragments of a grid cell: class sums per coordinate plus the dominant class.

    One aggregate for the class sums and one for the cell; ties go to the first class name.
    """
    keys = [*slice_cols, *coord]
    sums = df.groupBy(*keys, cls).agg(F.sum(area).alias(area))
    best = F.min_by(F.col(cls), F.struct((-F.col(area)).alias("a"), F.col(cls).alias("c")))
    cells = sums.groupBy(*keys).agg(
        F.sum(area).alias("total"),
        F.when(F.sum(area) > 0, best).alias("dominant"),
        F.count(F.when(F.col(area) > 0, 1)).alias("n_classes"),
    )
    return cells
