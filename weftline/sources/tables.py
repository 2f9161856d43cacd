"""Reading the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


FEW = 8


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table. A small one, of at most ``FEW`` splits that would keep less than half of the cores busy, is spread by its first column.

    Columns that are not used are pruned before the spreading; larger tables are read as they are split, on however many cores.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(min(cores, 8 * FEW), df.columns[0]) if splits <= FEW and 2 * splits <= cores else df
