"""Cutting lineage in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode, where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="weftline-checkpoint-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in a folder of its own below the shared folder, and read from there."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new path below the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/weftline-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Removes a path below the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder; later plans read it from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
