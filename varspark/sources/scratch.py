"""Tables and text files in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a local master gets a temporary one; on a cluster that is an error, for no
    local folder is seen by all executors."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def held(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back: worked out once, and not again when an executor is lost."""
    return held_at(df, new_path(df.sparkSession, "held"))


def held_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(lines: DataFrame, name: str) -> str:
    """The path of a folder of text files with the one column of `lines`."""
    path = new_path(lines.sparkSession, name)
    lines.write.text(path)
    return path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables or texts of the shared folder that nothing is read from any more."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps that are done; it does so when the driver collects its garbage. Python's references reach
    the JVM with a delay, hence the second round."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)
