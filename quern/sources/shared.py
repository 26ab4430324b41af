"""Folders that the driver and all executors see, for tables between two steps."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one, or a temporary one in a purely local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def stored(df: DataFrame, before: str | None = None) -> tuple[DataFrame, str]:
    """``df`` written to a shared folder and read back, and that folder; the folder ``before``, which no later step reads, is deleted.

    The lineage ends here, and what is written outlives executors.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/rows"
    df.write.parquet(path)
    if before is not None:
        discard(spark, before)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished queries deleted: Spark does so when their plans are collected, which the first collection only finds out."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``stored`` wrote."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
