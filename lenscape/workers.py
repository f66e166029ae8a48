"""What jobs need from the session: the package on Python workers, and a shared folder to cut lineage in."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def find_package(spark: SparkSession) -> None:
    """Workers on this machine find the package by its path; on a cluster it comes by --py-files."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


def shared_base(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, one of our own if all runs on this machine, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
    return base.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's address below spark.checkpoint.dir."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once, kept in the folder of spark.checkpoint.dir."""
    spark = df.sparkSession
    if spark.sparkContext.getConf().get("spark.checkpoint.dir") is None:
        spark.sparkContext.setCheckpointDir(shared_base(spark))
    return df.checkpoint()
