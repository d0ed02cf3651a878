"""Tables in Parquet files."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table at a path. One of fewer files than there are cores is dealt to all cores, as a file may be one row group, which one task reads.

    Larger tables, which have more splits than that, are left as they are: their rows are not shuffled.
    """
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() <= 2 * cores and len(df.inputFiles()) < cores
    return df.repartition(cores) if few else df


def narrow_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Smaller Arrow batches, in rows and bytes: a batch of long texts then fits a Python worker.

    Plans read these settings when they run, so they stay set; a caller's own smaller ones are kept.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = (spark.conf.get(f"spark.sql.execution.arrow.{name}") or "0").removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset one of our own in local mode, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and returns what was written: no lineage, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
