"""What the operators share: the cluster's checkpoint folder, written tables and Arrow settings."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from proselens.session import reachable

#: Used only in local mode, where the driver is the executor, if the session names no folder.
FALLBACK_DIR = "/tmp/checkpoints/proselens"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir. A cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/proselens/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that no later plan reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Spark's setting by which the shuffle files of a finished execution are deleted at once, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str, cleanup: bool = False) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read again. A lost executor costs a read. With cleanup, the
    shuffle files that led to the table are deleted."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, tag)
    before = spark.conf.get(CLEANUP, None)
    if cleanup:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if cleanup:
            spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = 512) -> None:
    """Few rows an Arrow batch, as texts may be long; a setting that the user chose stays. Spark reads it when the query runs, so it is left set."""
    reachable(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
