"""FASTA and FASTQ files as DataFrames, and SAM-style lines as text files.

Readers take a file or a folder of files. Records come in file order (``ord``,
counting on over all files in order of their path), whatever splits the files are
read in; no record runs over the end of a file. FASTA records may have any number
of lines; what stands before the first name of a file is left out; names
lose every ``>``, blank and tab, sequences all white space. FASTQ records have
four lines, or two (name and sequence) with ``lines=2``; the first symbol of the
name line is dropped; a record with an empty name line is left out. Empty files
give no rows. A FASTQ file must hold a whole number of records; a rest without a
sequence line gives a null sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.sequences import clean_fasta_name, clean_fastq_name, clean_seq
from weftline.plans.ordinal import in_file_order, with_ordinal, with_place


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``ord, name, seq``. A line that begins with ``>`` names a record; a ``>`` within a line of sequence ends it and names the next.

    A line finds its name line within its split, or as the last one of the splits before in its file, so no task reads a whole file.
    """
    lines = with_place(spark.read.text(path))
    value = F.regexp_replace("value", r"[\r\x00]", "")
    part = lambda named, v: F.struct(F.lit(named).alias("named"), v.alias("v"))
    at = F.instr("value", ">")
    parts = F.when(at == 1, F.array(part(True, value))).when(at == 0, F.array(part(False, value))).otherwise(F.array(part(False, F.regexp_replace(value, ">.*", "")), part(True, F.regexp_replace(value, "^[^>]*", ""))))
    rows = lines.select("_file", "_block", "_m", F.posexplode(parts).alias("k", "p")).select("_file", "_block", "_m", "k", "p.*")
    here = F.when(F.col("named"), F.struct("_block", "_m", "k"))
    w = Window.partitionBy("_file", "_block").orderBy("_m", "k").rowsBetween(Window.unboundedPreceding, 0)
    # One row per split.
    last = rows.groupBy("_file", "_block").agg(F.max(here).alias("last"))
    upto = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select("_file", "_block", F.last("last", True).over(upto).alias("before"))
    keyed = rows.withColumn("here", F.last(here, True).over(w)).join(before, ["_file", "_block"]).select("_file", F.coalesce("here", "before").alias("record"), "_block", "_m", "k", "named", "v")
    texts = F.transform(F.array_sort(F.collect_list(F.when(~F.col("named"), F.struct("_block", "_m", "k", "v")))), lambda r: r["v"])
    records = keyed.where("record IS NOT NULL").groupBy("_file", "record").agg(F.max(F.when(F.col("named"), F.col("v"))).alias("name"), F.regexp_replace(F.array_join(texts, ""), r"\s", "").alias("seq"))
    flat = records.select("_file", F.col("record._block").alias("_block"), F.col("record._m").alias("_at"), F.col("record.k").alias("k"), clean_fasta_name(F.col("name")).alias("name"), "seq")
    return with_ordinal(flat, "_file", "_block", "_at", "k").select("ord", "name", "seq")


def read_fastq(spark: SparkSession, path: str, lines: int = 4) -> DataFrame:
    """``ord, name, seq, qual``; ``qual`` is null in the two-line form."""
    if lines not in (2, 4):
        raise ValueError("lines must be 2 or 4")
    numbered = in_file_order(spark.read.text(path), lines)
    at = lambda k: F.max(F.when(F.col("part") == k, F.regexp_replace("value", r"\r\z", "")))
    rows = numbered.groupBy(F.col("unit").alias("ord")).agg(at(0).alias("name"), at(1).alias("seq"), (at(3) if lines == 4 else F.lit(None).cast("string")).alias("qual"))
    return rows.where(F.col("name") != "").select("ord", F.substring("name", 2, 1 << 30).alias("name"), "seq", "qual")


def write_fasta(records: DataFrame, path: str, width: int = 80) -> None:
    """Records ``name, seq`` as a folder of FASTA files with lines of ``width``; null is empty."""
    seq = F.coalesce("seq", F.lit(""))
    # All widths at once: a line break after each full line but the last.
    body = F.regexp_replace(seq, f"(.{{{int(width)}}})(?=.)", "$1\n")
    records.select(F.concat(F.lit(">"), F.coalesce("name", F.lit("")), F.lit("\n"), body).alias("value")).write.text(path)


def write_fastq(records: DataFrame, path: str) -> None:
    """Records ``name, seq, qual`` as a folder of FASTQ files of four lines each; null is empty."""
    field = lambda c: F.coalesce(c, F.lit(""))
    records.select(F.concat(F.lit("@"), field("name"), F.lit("\n"), field("seq"), F.lit("\n+\n"), field("qual")).alias("value")).write.text(path)


def fasta_records(table: DataFrame) -> DataFrame:
    """Cleaned records of a delivered table ``ord, name, seq``: redelivered rows once; null names and sequences stay null."""
    return table.select("ord", clean_fasta_name(F.col("name")).alias("name"), clean_seq(F.col("seq")).alias("seq")).distinct()


def fastq_records(table: DataFrame) -> DataFrame:
    """The same of ``ord, name, seq, qual``."""
    return table.select("ord", clean_fastq_name(F.col("name")).alias("name"), clean_seq(F.col("seq")).alias("seq"), "qual").distinct()


def sam_line() -> Column:
    """The five columns separated by tabs, as they are written."""
    return F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("0" if c == "pos" else "*")) for c in ("qname", "rname", "pos", "cigar", "seq")))


def write_sam(rows: DataFrame, path: str) -> None:
    rows.select(sam_line().alias("value")).write.text(path)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", quote="", schema="qname string, rname string, pos int, cigar string, seq string")


def placed(rows: DataFrame) -> DataFrame:
    """Distinct stored placements that name a read, a sequence and a position."""
    return rows.where("qname IS NOT NULL AND rname <> '*' AND pos > 0 AND cigar <> '*'").distinct()


def newest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """One row per key, the last by ``at``; of equal ones any, as redelivered rows are the same."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
