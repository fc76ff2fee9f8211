"""Tables that a plan reads more than once: written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the context's checkpoint folder; only a local session may make one of its own."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if where:
        return where
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="rowgate-"))
    return sc.getCheckpointDir()


def files_of(spark: SparkSession, path: str):
    """A path and its file system, whichever that is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    at, fs = files_of(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{path}/data"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written and read back: what follows reads only the columns it needs, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
