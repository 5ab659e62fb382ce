"""Lineage cuts: tables in the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; one of our own only where none is set and all runs in one process."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="factloom-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: no lineage, safe against lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._factloom_path = path
    _system(spark, path)[0].deleteOnExit(_system(spark, path)[1])  # what nobody drops goes with the application
    return out


def _system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def drop(*frames: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_factloom_path", None)
        if path:
            system, p = _system(df.sparkSession, path)
            system.delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished phases, which it does when its driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()
