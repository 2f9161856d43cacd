"""Reads as they arrive: the same stateless operators on streams.

``read_stream`` follows a folder of Parquet files. Matching needs no state, so a
restarted query goes on from its checkpoint; with ``within`` redelivered records
are dropped by a watermark on ``read_at``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.sequences import clean_fastq_name, clean_seq
from weftline.operators.exact import exact_matches

SCHEMA = "ord bigint, name string, seq string, qual string, run string, read_at timestamp_ntz"


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def clean_reads(stream: DataFrame, within: str | None = None) -> DataFrame:
    """``ord, name, seq`` cleaned; repeated ``ord`` within the given delay are dropped."""
    rows = stream.select("ord", clean_fastq_name(F.col("name")).alias("name"), clean_seq(F.col("seq")).alias("seq"), F.col("read_at").cast("timestamp").alias("read_at"))
    if within:
        rows = rows.withWatermark("read_at", within).dropDuplicatesWithinWatermark(["ord"])
    return rows


def match_stream(stream: DataFrame, patterns: DataFrame, strategy: str = "automaton") -> DataFrame:
    """``text_id, pattern_id, pos`` of a stated set of patterns in the arriving reads (``text_id`` is ``ord``)."""
    texts = clean_reads(stream).select(F.col("ord").alias("text_id"), F.col("seq").alias("text"))
    return exact_matches(texts, patterns, strategy)


def counts_by_time(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """``beg, reads, symbols`` per tumbling window of ``read_at``; later rows than ``late`` are left out."""
    rows = clean_reads(stream).withWatermark("read_at", late)
    return rows.groupBy(F.window("read_at", window).alias("w")).agg(F.count("*").alias("reads"), F.sum(F.length("seq")).alias("symbols")).select(F.col("w.start").alias("beg"), "reads", "symbols")
