"""Session settings and lineage control."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on: adaptive plans split skewed join partitions and pick
# broadcast sides from measured sizes, so no operator needs a size guess of its own.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and written tables: the cluster's ``spark.checkpoint.dir``; below the shared warehouse where it is unset."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if warehouse.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"{warehouse.rstrip('/')}/_checkpoints"
    spark.sparkContext.setCheckpointDir(shared)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` reliably, so that an iterative job survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Shuffle files of a finished write serve nothing any more: the written table has cut the lineage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cut lineage, columnar, and with a size that the planner knows.

    The shuffle files of the write go when it ends. The table is removed by ``release``, or when the session's JVM ends. Rows that are wide on their
    way to Python go there in batches of ``batch_rows`` at most.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    before, rows = spark.conf.get(CLEANUP, None), spark.conf.get(ARROW_ROWS, None)
    cleans = spark.conf.isModifiable(CLEANUP)  # this Spark knows the setting; it is off unless set
    if cleans:
        spark.conf.set(CLEANUP, "true")
    if batch_rows and not 0 < int(rows or 0) < batch_rows:
        spark.conf.set(ARROW_ROWS, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)
        elif cleans:
            spark.conf.unset(CLEANUP)
        if rows is not None:
            spark.conf.set(ARROW_ROWS, rows)
        elif batch_rows:
            spark.conf.unset(ARROW_ROWS)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(table._written_path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


# Bytes of stored input for a shuffle partition, and bytes of shuffled rows that a task takes at most when partitions are joined.
INPUT_BYTES, TASK_BYTES, MOST = 3 * 2**20, 6 * 2**20, 20_000
INITIAL, ADVISORY = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_dealt: dict[str, dict[str, str]] = {}  # application → settings made here


def deal_by_size(spark: SparkSession, folder: str) -> None:
    """Let the number of shuffle partitions follow the stored bytes of ``folder``, and adaptive plans join only small ones, so a task's memory does not
    grow with the tables. Settings that the caller has made stay."""
    deal_as_set(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    stored = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST, -(-stored // INPUT_BYTES)))
    for key, value in ((INITIAL, str(partitions)), (ADVISORY, str(TASK_BYTES))):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
            _dealt.setdefault(spark.sparkContext.applicationId, {})[key] = value


def deal_as_set(spark: SparkSession) -> None:
    """Take back what ``deal_by_size`` has set."""
    for key, value in _dealt.pop(spark.sparkContext.applicationId, {}).items():
        if spark.conf.get(key, None) == value:
            spark.conf.unset(key)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, which may have been started elsewhere; once for an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="gridpanel-")) / "gridpanel.zip"  # the driver serves it; executors fetch their own copy
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
