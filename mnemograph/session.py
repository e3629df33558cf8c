"""Session settings and lineage cuts that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by ``checkpoint()`` into the folder that the cluster names in
    ``spark.checkpoint.dir``; a folder of our own is set only where that is unset on a local master."""
    spark: SparkSession = df.sparkSession
    if not spark.sparkContext.getConf().get("spark.checkpoint.dir") and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="mnemograph-"))
    return df.checkpoint()


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh folder in the one that driver and executors share, deleted when the application ends."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        named = "file://" + tempfile.mkdtemp(prefix="mnemograph-")
        spark.conf.set("spark.checkpoint.dir", named)
    path = f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def spread(df: DataFrame) -> DataFrame:
    """``df`` with its rows dealt out over the cores, where its table has fewer files than these.

    A small file may be one row group, which one task reads, and all that follows on it would be that task's. Tables
    of many files stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df
