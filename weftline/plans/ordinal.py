"""Ordinal numbers over a whole DataFrame without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.lineage import cut


def with_ordinal(df: DataFrame, *by: str, name: str = "ord") -> DataFrame:
    """``df`` with 0-based numbers in order of ``by``: rows are range-partitioned, numbered within partitions and shifted by the sizes before.

    Equal keys stay together but their order is not fixed, so ``by`` should be unique. The table of sizes has one row per partition.
    """
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id())
    return _shifted(cut(placed), name)


def with_first_ordinal(df: DataFrame, *by: str, name: str = "ord", number: str = "number", without: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the ordinal in order of ``by`` of the first row that has the same keys, and the number of these rows.

    One shuffle, as equal keys stay together. Columns of ``without`` are left out once they have served.
    """
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    same, kept = Window.partitionBy(*by), [c for c in df.columns if c not in without]
    return _shifted(cut(placed.select(*kept, F.min("_at").over(same).alias("_m"), F.count("*").over(same).alias(number))), name)


SPLITS = 100_000


def with_place(df: DataFrame) -> DataFrame:
    """Rows of a file source with their place: ``_file`` (path), ``_block`` (where the split begins) and ``_m``, in order within a split.

    A split lies within one partition, but a partition may hold splits of several files and not in their order.
    """
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_m"))


def in_file_order(df: DataFrame, of: int = 1) -> DataFrame:
    """Rows of a file source in units of ``of`` rows that never run over a file's end: ``unit`` counts on over the files in order of path, ``part`` is the row's place in its unit.

    The files are read twice, first for the sizes of their splits, of which there is one row each; these are sent to all
    workers while they are at most ``SPLITS``, and joined by shuffle beyond.
    """
    placed = with_place(df)
    sizes = cut(placed.groupBy("_file", "_block").agg(F.min("_m").alias("_first"), F.count("*").alias("_n")))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = sizes.select("_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    units = sizes.groupBy("_file").agg(F.ceil(F.sum("_n") / of).alias("_units"))
    # One row per file.
    files = units.select("_file", F.coalesce(F.sum("_units").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    known = splits.join(files, "_file")
    known = F.broadcast(known) if sizes.count() <= SPLITS else known
    line = F.col("_m") + F.col("_shift")
    return placed.join(known, ["_file", "_block"]).select(*df.columns, (F.col("_start") + F.floor(line / of)).alias("unit"), (line % of).alias("part"))


def _shifted(placed: DataFrame, name: str) -> DataFrame:
    placed = placed.withColumn("_p", F.shiftright("_m", 33)).withColumn("_m", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("n")).select("_p", before.alias("_before"))
    return placed.join(F.broadcast(sizes), "_p").withColumn(name, F.col("_m") + F.col("_before")).drop("_p", "_m", "_before")
