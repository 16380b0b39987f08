"""Tables in the folder that all executors share, and tables that are kept under a name for later runs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or what setCheckpointDir() was given; a folder of our own only in local mode, as in tests."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="phonoweave-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    there = context._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written there and read again: lineage ends, and lost executors take nothing with them."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
