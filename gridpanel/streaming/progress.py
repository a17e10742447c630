"""Running summaries of draw batches as they arrive in a folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def running_stats(draws: DataFrame, by: Sequence[str] = ("chain", "param"), order: str = "iter", value: str = "value") -> DataFrame:
    """Count, mean, variance and latest iteration per chain and parameter.

    The same aggregation serves a batch and a stream: state per key is a few numbers, whatever the number of draws.
    """
    return draws.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), F.max(order).alias("last_iter")
    )


def chain_progress(draws: DataFrame, target: int, chain: str = "chain", order: str = "iter") -> DataFrame:
    """Latest iteration per chain and its share of the target."""
    out = draws.groupBy(chain).agg(F.max(order).alias("last_iter"), F.count(F.lit(1)).alias("n_rows"))
    return out.withColumn("done", F.least(F.col("last_iter") / F.lit(float(target)), F.lit(1.0)))


def watch_draws(
    spark: SparkSession, path: str, schema: StructType | str, pattern: str = "*.parquet", max_files: int = 100
) -> DataFrame:
    """Stream of the Parquet draw batches that appear under the folder ``path`` with a name matching ``pattern``."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", pattern)
    return reader.parquet(path)


def start_running_stats(stream: DataFrame, name: str, checkpoint: str, **kwargs) -> StreamingQuery:
    """Keep running statistics in an in-memory table, the view of a monitor."""
    stats = running_stats(stream, **kwargs)
    writer = stats.writeStream.outputMode("complete").format("memory").queryName(name)
    return writer.option("checkpointLocation", checkpoint).start()


def upsert_running_stats(stream: DataFrame, path: str, checkpoint: str, **kwargs) -> StreamingQuery:
    """Write changed keys of every trigger to ``path``, one folder per batch; replays of a batch overwrite it."""
    stats = running_stats(stream, **kwargs)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stats.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).start()
