"""Reads against sequences: every verbatim place of every read, as SAM-style rows.

``fastq(ord, name, seq)`` and ``fasta(ord, name, seq)`` are cleaned first. Each
record counts once. Results for odd input: records with a null name keep it as
null; null and empty sequences have no place; records of equal name and content
but different ``ord`` each give their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.sequences import clean_fastq_name, clean_seq
from weftline.operators.approx import approx_by_seed
from weftline.operators.exact import by_seed, exact_matches
from weftline.plans.lineage import cut
from weftline.sources.sequence_files import fasta_records, read_fasta, read_fastq, write_sam

# The names of the tool's algorithms, and of the further strategies.
ALGORITHMS = {"naive": "find", "ba": "border", "kmp": "kmp", "automaton": "automaton", "scan": "scan", "seed": "seed"}


HASH = ("h1", "h2")


def _sides(reads: DataFrame, sequences: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The names of the reads with a hash of 128 bits of their sequence, the sequences, the different reads (written), and the texts.

    Copies of a read are searched once, and the texts of reads are grouped once.
    """
    rows = reads.select(F.col("ord").alias("read_id"), clean_fastq_name(F.col("name")).alias("qname"), clean_seq(F.col("seq")).alias("pattern")).where("pattern <> ''")
    hashed = lambda c: (F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(1), c).alias("h2"))
    names = rows.select("read_id", "qname", *hashed("pattern")).distinct()
    patterns = cut(rows.groupBy("pattern").agg(F.min("read_id").alias("pattern_id")).where("pattern_id IS NOT NULL").select("pattern_id", "pattern", *hashed("pattern")))
    r = fasta_records(sequences).where("seq <> ''").select(F.col("ord").alias("text_id"), F.col("name").alias("rname"), F.col("seq").alias("text"))
    return names, r, patterns, r.select("text_id", "text").distinct()


def map_reads(reads: DataFrame, sequences: DataFrame, strategy: str = "seed") -> DataFrame:
    """``qname, rname, pos`` (1-based), ``cigar, seq``."""
    names, r, patterns, texts = _sides(reads, sequences)
    words = patterns.select("pattern_id", "pattern")
    hits = by_seed(texts, words, unique=True) if strategy == "seed" else exact_matches(texts, words, strategy)
    named = hits.join(patterns, "pattern_id").join(names, [*HASH]).join(r.select("text_id", "rname"), "text_id")
    return named.select("qname", "rname", (F.col("pos") + 1).cast("int").alias("pos"), F.concat(F.length("pattern").cast("string"), F.lit("M")).alias("cigar"), F.col("pattern").alias("seq"))


def map_reads_approx(reads: DataFrame, sequences: DataFrame, d: int) -> DataFrame:
    """The same within ``d`` edits; the CIGAR runs from the read's start. Short reads are sent to all workers in blocks, others meet the sequences by seeds."""
    names, r, patterns, texts = _sides(reads, sequences)
    hits = approx_by_seed(texts, patterns.select("pattern_id", "pattern"), d, unique=True).select("text_id", "pattern_id", "pos", "cigar_fwd")
    named = hits.join(patterns, "pattern_id").join(names, [*HASH]).join(r.select("text_id", "rname"), "text_id")
    return named.select("qname", "rname", (F.col("pos") + 1).cast("int").alias("pos"), F.col("cigar_fwd").alias("cigar"), F.col("pattern").alias("seq"))


def map_files(spark: SparkSession, algorithm: str, fasta: str, fastq: str, out: str, lines: int = 4) -> None:
    """Every verbatim place of every read of FASTQ files in the sequences of FASTA files, written as a folder of SAM-style lines."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm: {algorithm}")
    write_sam(map_reads(read_fastq(spark, fastq, lines), read_fasta(spark, fasta), ALGORITHMS[algorithm]), out)
