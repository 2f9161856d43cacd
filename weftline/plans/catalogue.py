"""Queries of the core operators over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import alphabets, bits, slices
from weftline.functions.sequences import clean_seq
from weftline.functions.units import by_bytes
from weftline.operators import approx, exact, fm, index, suffix
from weftline.operators.mapping import map_files, map_reads, map_reads_approx
from weftline.plans.lineage import scratch, stored
from weftline.sources import raw_records
from weftline.sources.sequence_files import fasta_records, fastq_records, placed, read_fasta, read_fastq, read_sam, sam_line, write_fasta, write_fastq
from weftline.sources.tables import table
from weftline.streaming.reads import match_stream, read_stream

Query = Callable[[SparkSession, str], DataFrame]


def _parts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("text_id"), F.col("p_name").alias("text"))


def _sequences(s: SparkSession, d: str, name: str = "fasta") -> DataFrame:
    """The records of a table, each once, with clean sequences."""
    return table(s, d, name).select(F.col("ord").alias("text_id"), clean_seq(F.col("seq")).alias("text")).where("text IS NOT NULL").distinct()


def _reads(s: SparkSession, d: str) -> DataFrame:
    return _sequences(s, d, "fastq")


def _pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("text_id"), "text")


def _patterns(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "patterns")


def _words(s: SparkSession, words: tuple[str, ...]) -> DataFrame:
    return s.createDataFrame([(i, w) for i, w in enumerate(words)], "pattern_id bigint, pattern string")


def _codes(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), ",")


TREE_WORDS, NEAR_WORDS, READ_WORDS = ("e", "in", "red", "", "zq", "ing", "gear x", "small bolt"), ("ring", "bolt", "red"), ("GATTACA", "ACGTACGTAC", "TTAGGN")


def _x() -> Column:
    return F.col("text")


def _with_alphabet(texts: DataFrame) -> DataFrame:
    return texts.withColumn("syms", alphabets.symbols_of(_x())).withColumn("codes", alphabets.mapped(_x(), F.col("syms")))


def _stored_pairs(s: SparkSession, d: str) -> DataFrame:
    """Stored placements with the reads of their name."""
    sam = table(s, d, "sam").select("qname", F.col("seq").alias("x")).where("x IS NOT NULL").distinct()
    reads = fastq_records(table(s, d, "fastq")).select(F.col("name").alias("qname"), F.col("seq").alias("y")).where("y IS NOT NULL").distinct()
    return sam.join(reads, "qname")


def _flags(texts: DataFrame) -> DataFrame:
    """Bit vectors of the places of A."""
    return texts.withColumn("v", bits.pack(bits.from_string(F.translate(F.regexp_replace(_x(), "[^A]", "0"), "A", "1"))))


def _missing(s: SparkSession, d: str) -> DataFrame:
    """Occurrences that the stored table of an earlier run lacks."""
    stored = table(s, d, "exact_matches").where("pattern_id IS NOT NULL").distinct()
    return exact.exact_matches(_sequences(s, d), _patterns(s, d)).join(stored, ["text_id", "pattern_id", "pos"], "left_anti")


def _located(s: SparkSession, d: str) -> DataFrame:
    found = F.col("outcome").isin("node match", "edge match")
    lo, hi = (F.when(found, F.col(c)).alias(c) for c in ("sa_lo", "sa_hi"))
    return suffix.tree_locate(_parts(s, d), _words(s, TREE_WORDS)).select("text_id", "pattern_id", "matched", found.alias("found"), lo, hi)


def _index(texts: DataFrame, use: str) -> DataFrame:
    """The index of the texts as a written table."""
    return stored(index.build_index(texts, use))


def _fasta_files(s: SparkSession, d: str) -> str:
    """The named records of the table, written as a folder of files."""
    path = scratch(s)
    write_fasta(fasta_records(table(s, d, "fasta")).where("name <> ''").repartition(5, "ord"), path)
    return path


def _fastq_files(s: SparkSession, d: str) -> str:
    path = scratch(s)
    write_fastq(fastq_records(table(s, d, "fastq")).where("name <> ''").repartition(7, "ord"), path)
    return path


def _mapped_files(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s)
    map_files(s, "seed", _fasta_files(s, d), _fastq_files(s, d), path)
    return read_sam(s, path)


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """Matches in the rows of the table as they arrive, redelivered ones included, written by a stream and read from there."""
    path = scratch(s)
    # A pattern stands for a table in one file as well as for a folder of files.
    found = match_stream(read_stream(s, f"{d}/fastq.parque[t]"), _words(s, ("GATTACA",)))
    run = found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return s.read.schema("text_id bigint, pattern_id bigint, pos bigint").parquet(f"{path}/out")


def queries() -> dict[str, Query]:
    return {
        # slices and buffers
        "slice_index": lambda s, d: _reads(s, d).select("text_id", slices.symbol_at(_x(), 2).alias("third"), slices.symbol_at(_x(), -1).alias("last")),
        "slice_prefix": lambda s, d: _reads(s, d).select("text_id", slices.prefix(_x(), 10).alias("ten"), slices.prefix(_x(), -3).alias("but_three")),
        "slice_suffix": lambda s, d: _reads(s, d).select("text_id", slices.suffix(_x(), 5).alias("from_five"), slices.suffix(_x(), -4).alias("four")),
        "slice_sub": lambda s, d: _reads(s, d).select("text_id", slices.subslice(_x(), 3, -3).alias("middle"), slices.subslice(_x(), -12, -2).alias("near_end")),
        "slice_reverse": lambda s, d: _reads(s, d).select("text_id", slices.reverse(_x()).alias("reversed")),
        "slice_compare": lambda s, d: _stored_pairs(s, d).select("qname", "x", "y", slices.same(F.col("x"), F.col("y")).alias("eq"), slices.at_most(F.col("x"), F.col("y")).alias("le"), slices.at_least(F.col("x"), F.col("y")).alias("ge")),
        "slice_lcp": lambda s, d: _stored_pairs(s, d).select("qname", "x", "y", slices.common_prefix(F.col("x"), F.col("y")).alias("lcp")),
        "slice_format": lambda s, d: _parts(s, d).select("text_id", slices.formatted(_x()).alias("shown")),
        "slice_array": lambda s, d: _with_alphabet(_reads(s, d)).select("text_id", _codes(slices.subslice(F.col("codes"), 2, -2, True)).alias("middle"), slices.symbol_at(F.col("codes"), -1, True).alias("last"), _codes(slices.reverse(F.col("codes"))).alias("reversed")),
        "buffer_append": lambda s, d: _reads(s, d).select("text_id", slices.append(_x(), F.lit("ACGT")).alias("more"), slices.append_at(_x(), 4, F.lit("TT")).alias("cut_more")),
        "text_length": lambda s, d: _pages(s, d).select("text_id", F.length(_x()).cast("bigint").alias("n"), F.octet_length(_x()).cast("bigint").alias("bytes")),
        # bit vectors
        "bitvector_matches": lambda s, d: bits.from_positions(_reads(s, d).join(exact.exact_matches(_reads(s, d), _words(s, ("A",)), "scan"), "text_id", "left").withColumn("n", F.length("text").cast("bigint")), "text_id", "pos", "n").select("text_id", "no_bits", _codes(F.col("words")).alias("words")),
        "bitvector_words": lambda s, d: _flags(_reads(s, d)).select("text_id", "v.no_bits", _codes(F.col("v.words")).alias("words")),
        "bitvector_set": lambda s, d: _flags(_reads(s, d)).select("text_id", bits.get(F.col("v"), 7).alias("eighth"), bits.formatted(bits.put(bits.put(F.col("v"), 65, True), 0, False)).alias("shown"), bits.same(F.col("v"), bits.put(F.col("v"), 2, True)).alias("third_set")),
        "bitvector_clear": lambda s, d: _flags(_reads(s, d)).select("text_id", bits.formatted(bits.clear(F.col("v"))).alias("shown"), bits.same(bits.clear(F.col("v")), bits.zeros(F.length(_x()))).alias("zero")),
        # alphabets
        "alphabet_build": lambda s, d: alphabets.alphabet(_sequences(s, d)),
        "alphabet_map": lambda s, d: _with_alphabet(_reads(s, d)).select("text_id", _codes(F.col("codes")).alias("codes")),
        "alphabet_roundtrip": lambda s, d: _with_alphabet(_reads(s, d)).select("text_id", alphabets.unmapped(F.col("codes"), F.col("syms")).alias("text")),
        "alphabet_unmappable": lambda s, d: _with_alphabet(_reads(s, d)).select("text_id", alphabets.mapped(F.lit("ACGTN"), F.col("syms")).isNull().alias("unmappable")),
        # exact matching
        "exact_positions": lambda s, d: exact.exact_matches(_pages(s, d), _words(s, ("en",)), "scan").select("text_id", "pos"),
        "exact_counts": lambda s, d: exact.exact_matches(_sequences(s, d), _words(s, ("GATTA",)), "find").groupBy("text_id").agg(F.count("*").alias("n")),
        "exact_overlapping": lambda s, d: exact.exact_matches(_reads(s, d), _words(s, ("AAA",)), "scan").select("text_id", "pos"),
        "exact_border": lambda s, d: exact.exact_matches(_reads(s, d), _words(s, ("AATAA", "TTT")), "border"),
        "exact_linear": lambda s, d: exact.exact_matches(_pages(s, d), _words(s, ("en",)), "kmp").select("text_id", "pos"),
        "exact_multi_pattern": lambda s, d: exact.exact_matches(_sequences(s, d), _patterns(s, d)),
        "exact_seed": lambda s, d: exact.exact_matches(_sequences(s, d), _patterns(s, d), "seed"),
        "exact_missing": _missing,
        "exact_find_pages": lambda s, d: exact.exact_matches(_pages(s, d), _words(s, ("qu", "ij")), "find"),
        "exact_bytes": lambda s, d: exact.exact_matches(by_bytes(_pages(s, d), "text"), by_bytes(_words(s, ("é", "en")), "pattern"), "automaton"),
        "border_array": lambda s, d: exact.border_arrays(_patterns(s, d)).select("pattern_id", _codes(F.col("borders")).alias("borders")),
        "border_array_restricted": lambda s, d: exact.border_arrays(_patterns(s, d)).select("pattern_id", _codes(F.col("restricted")).alias("restricted")),
        # suffix structures
        "suffix_array": lambda s, d: suffix.suffix_array(_sequences(s, d)),
        "suffix_array_doubling": lambda s, d: suffix.suffix_array(_parts(s, d), "doubling"),
        "suffix_array_inverse": lambda s, d: suffix.inverse_suffix_array(_reads(s, d)),
        "lcp_array": lambda s, d: suffix.lcp_array(_reads(s, d)),
        "sl_types": lambda s, d: suffix.suffix_types(_reads(s, d)),
        "lms_positions": lambda s, d: suffix.lms_positions(_reads(s, d)),
        "symbol_buckets": lambda s, d: suffix.symbol_buckets(_sequences(s, d)),
        "sa_search": lambda s, d: suffix.sa_search(_sequences(s, d), _patterns(s, d)),
        "sa_search_indexed": lambda s, d: index.search_index(_index(_sequences(s, d), "sa"), _patterns(s, d), "sa"),
        "st_search_indexed": lambda s, d: index.search_index(_index(_parts(s, d), "tree"), _words(s, TREE_WORDS), "tree"),
        "st_nodes_reads": lambda s, d: suffix.tree(_reads(s, d)),
        "approx_reads": lambda s, d: approx.approx_matches(_reads(s, d), _words(s, READ_WORDS), 1),
        "st_nodes": lambda s, d: suffix.tree(_parts(s, d)),
        "st_leaves": lambda s, d: suffix.tree_leaves(_parts(s, d)),
        "st_locate": _located,
        "st_search": lambda s, d: suffix.tree_search(_parts(s, d), _words(s, TREE_WORDS)),
        # transform and index
        "bwt": lambda s, d: fm.bwt(_reads(s, d)),
        "bwt_reversed": lambda s, d: fm.bwt_of_reverse(_reads(s, d)),
        "c_table": lambda s, d: fm.c_table(_sequences(s, d)),
        "o_table": lambda s, d: fm.o_table(_reads(s, d)),
        "lf_mapping": lambda s, d: fm.lf_mapping(_reads(s, d)),
        "bwt_inverse": lambda s, d: fm.inverse_bwt(fm.bwt(_sequences(s, d))),
        "fm_search": lambda s, d: fm.fm_search(_sequences(s, d), _patterns(s, d)).select("text_id", "pattern_id", "pos"),
        "fm_search_indexed": lambda s, d: index.search_index(_index(_sequences(s, d), "fm"), _patterns(s, d), "fm"),
        "fm_index": lambda s, d: fm.fm_index(_reads(s, d)),
        # approximate matching
        "approx_d1": lambda s, d: approx.approx_matches(_parts(s, d), _words(s, NEAR_WORDS), 1),
        "approx_d2": lambda s, d: approx.approx_matches(_parts(s, d), _words(s, NEAR_WORDS), 2).select("text_id", "pattern_id", "pos", "cigar", "dist"),
        "approx_best": lambda s, d: approx.best_matches(_parts(s, d), _words(s, NEAR_WORDS), 2),
        "approx_motifs": lambda s, d: approx.approx_matches(_sequences(s, d), _patterns(s, d), 1),
        "approx_indexed": lambda s, d: index.approx_index(_index(_sequences(s, d), "approx"), _patterns(s, d), 1),
        "cigar_encode": lambda s, d: approx.approx_matches(_parts(s, d), _words(s, NEAR_WORDS), 1).select("text_id", "pattern_id", "pos", "edits", approx.cigar(F.col("edits")).alias("cigar")),
        "d_table": lambda s, d: approx.needed_edits(_sequences(s, d), _patterns(s, d)).select("text_id", "pattern_id", _codes(F.col("needed")).alias("needed")),
        # sources, sinks and the tool
        "fasta_records": lambda s, d: fasta_records(table(s, d, "fasta")),
        "fastq_records": lambda s, d: fastq_records(table(s, d, "fastq")),
        "fasta_files": lambda s, d: read_fasta(s, _fasta_files(s, d)).select("name", "seq"),
        "fastq_files": lambda s, d: read_fastq(s, _fastq_files(s, d)).select("name", "seq", "qual"),
        "map_files_sam": _mapped_files,
        "read_mapping_approx": lambda s, d: map_reads_approx(table(s, d, "fastq"), table(s, d, "fasta"), 1),
        "stream_matches": _streamed,
        "sam_lines": lambda s, d: table(s, d, "sam").select(sam_line().alias("line")),
        "sam_placed": lambda s, d: placed(table(s, d, "sam")),
        "read_mapping_sam": lambda s, d: map_reads(table(s, d, "fastq"), table(s, d, "fasta")),
        # strict loading
        "p4_found": lambda s, d: raw_records.failed_rows(table(s, d, "raw_records")),
        "p4_fastq": lambda s, d: raw_records.strict_load(table(s, d, "raw_records"), "fastq"),
        "p4_fasta": lambda s, d: raw_records.strict_load(table(s, d, "raw_records"), "fasta"),
    }


# The same grammar for RE2; groups that only repeat do not capture.
_FIELD = r'(?:"[^"]*(?:""[^"]*)*"|[^",]*)'
_ROW = f"{_FIELD}(?:,{_FIELD})*"


def _parsed() -> str:
    """Rows without their CR, with the fields of those that have the right number."""

    def take(n: int, i: int) -> str:
        shape = ",".join([f"({_FIELD})"] * n)
        raw = f"regexp_extract(t, '^{shape}$', {i})"
        return f"CASE WHEN starts_with({raw}, '\"') THEN replace(substr({raw}, 2, length({raw}) - 2), '\"\"', '\"') ELSE {raw} END"

    def shape(n: int) -> str:
        return ",".join([_FIELD] * n)

    return f"""
row AS (SELECT raw_id, kind, CASE WHEN ends_with(raw_text, chr(13)) THEN left(raw_text, length(raw_text) - 1) ELSE raw_text END AS t FROM raw_records),
cut AS (
  SELECT raw_id, kind, t, {take(4, 1)} AS ord, {take(4, 2)} AS name, {take(4, 3)} AS seq, {take(4, 4)} AS qual FROM row WHERE kind = 'fastq' AND regexp_full_match(t, '{shape(4)}')
  UNION ALL
  SELECT raw_id, kind, t, {take(3, 1)}, {take(3, 2)}, {take(3, 3)}, NULL FROM row WHERE kind = 'fasta' AND regexp_full_match(t, '{shape(3)}')),
clean AS (SELECT *, upper(regexp_replace(seq, '[ \\t\\r\\n]', '', 'g')) AS s FROM cut),
good AS (
  SELECT * FROM clean WHERE regexp_full_match(ord, '[0-9]{{1,18}}') AND regexp_full_match(s, '[ACGTN]+') AND (
    kind = 'fastq' AND regexp_full_match(name, '@[!-~]+') AND regexp_full_match(qual, '[!-~]*') AND length(qual) = length(s)
    OR kind = 'fasta' AND regexp_full_match(name, '>[ -~\\t]*') AND regexp_replace(name, '[> \\t]', '', 'g') <> ''))"""


def _clean_sql(c: str = "seq") -> str:
    return f"upper(regexp_replace({c}, '[ \\t\\r\\n]', '', 'g'))"


_PARTS = "t AS (SELECT p_partkey AS text_id, p_name AS text FROM part)"
_SEQUENCES = f"t AS (SELECT DISTINCT ord AS text_id, {_clean_sql()} AS text FROM fasta WHERE seq IS NOT NULL)"
_READS = f"t AS (SELECT DISTINCT ord AS text_id, {_clean_sql()} AS text FROM fastq WHERE seq IS NOT NULL)"
_PAGES = "t AS (SELECT doc_id AS text_id, text FROM documents)"
_READ_NAME = "regexp_extract(name, '^@?([^ \\t/]*)', 1)"
_FASTQ = f"SELECT DISTINCT ord, CASE WHEN name IS NOT NULL THEN {_READ_NAME} END AS name, {_clean_sql()} AS seq, qual FROM fastq"
_FASTA = f"SELECT DISTINCT ord, regexp_replace(name, '[> \\t]', '', 'g') AS name, {_clean_sql()} AS seq FROM fasta"
_PAIRS = f"""reads AS ({_FASTQ}), xy AS (SELECT qname, x, y FROM (SELECT DISTINCT qname, seq AS x FROM sam WHERE seq IS NOT NULL) JOIN (SELECT DISTINCT name AS qname, seq AS y FROM reads WHERE seq IS NOT NULL) USING (qname))"""
_SYMS = "a AS (SELECT text_id, text, CASE WHEN text = '' THEN [] ELSE string_split(text, '') END AS chars, list_sort(list_distinct(CASE WHEN text = '' THEN [] ELSE string_split(text, '') END)) AS syms FROM t)"
_MAPPED = f"{_SYMS}, m AS (SELECT *, list_transform(chars, lambda c: list_position(syms, c)) AS codes FROM a)"
_BITS = "b AS (SELECT text_id, length(text) AS n, regexp_replace(regexp_replace(text, '[^A]', '0', 'g'), 'A', '1', 'g') AS bits FROM t)"


def _hits(word: str) -> str:
    """All places of one word."""
    m = len(word)
    return f"hits AS (SELECT text_id, pos FROM (SELECT text_id, text, unnest(range(0, length(text) - {m - 1})) AS pos FROM t WHERE length(text) >= {m}) WHERE substr(text, pos + 1, {m}) = '{word}')"


# One row per place of a pattern: windows of each pattern length that occurs.
_MATCHES = """
sizes AS (SELECT DISTINCT length(pattern) AS m FROM patterns),
win AS (SELECT text_id, m, pos, substr(text, pos + 1, m) AS w FROM (SELECT text_id, text, m, unnest(range(0, length(text) - m + 1)) AS pos FROM t, sizes WHERE length(text) >= m)),
met AS (SELECT DISTINCT text_id, pattern_id, pos FROM win JOIN patterns ON w = pattern)"""
_RANKS = """
suf AS (SELECT text_id, pos, substr(text, pos + 1) AS suffix FROM (SELECT text_id, text, unnest(range(0, length(text) + 1)) AS pos FROM t)),
sa AS (SELECT text_id, pos, suffix, row_number() OVER (PARTITION BY text_id ORDER BY suffix) - 1 AS rank FROM suf)"""
_BWT = f"""{_RANKS},
alpha AS (SELECT text_id, sym, row_number() OVER (PARTITION BY text_id ORDER BY sym) AS code FROM (SELECT DISTINCT text_id, left(suffix, 1) AS sym FROM suf WHERE suffix <> '')),
bwt AS (SELECT sa.text_id, rank, pos, CAST(coalesce(code, 0) AS INT) AS code, CASE WHEN pos > 0 THEN substr(text, pos, 1) END AS ch FROM sa JOIN t USING (text_id) LEFT JOIN alpha ON alpha.text_id = sa.text_id AND pos > 0 AND sym = substr(text, pos, 1)),
cs AS (SELECT text_id, code, CAST(coalesce(sum(n) OVER (PARTITION BY text_id ORDER BY code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c FROM (SELECT text_id, code, count(*) AS n FROM bwt GROUP BY text_id, code)),
os AS (SELECT text_id, rank, pos, code, ch, row_number() OVER (PARTITION BY text_id, code ORDER BY rank) AS occ FROM bwt)"""
_TYPES = f"{_RANKS}, ty AS (SELECT text_id, pos, coalesce(rank < lead(rank) OVER w, true) AS s_type FROM sa WINDOW w AS (PARTITION BY text_id ORDER BY pos))"
# Inner nodes are the prefixes of suffixes that go on in at least two ways; leaves are the suffixes.
_NODES = f"""{_RANKS},
pre AS (SELECT text_id, rank, pos, suffix, unnest(range(0, length(suffix) + 1)) AS depth FROM sa),
nodes AS (
  SELECT text_id, min(rank) AS sa_lo, max(rank) + 1 AS sa_hi, depth, NULL AS leaf_pos FROM pre GROUP BY text_id, depth, left(suffix, depth) HAVING depth = 0 OR count(DISTINCT substr(suffix, depth + 1, 1)) > 1
  UNION ALL SELECT text_id, rank, rank + 1, length(suffix) + 1, pos FROM sa),
num AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY sa_lo, sa_hi DESC, depth) - 1 AS node_id FROM nodes),
up AS (SELECT c.text_id, c.node_id, max(p.node_id) AS parent_id, max(p.depth) AS above FROM num c LEFT JOIN num p ON p.text_id = c.text_id AND p.sa_lo <= c.sa_lo AND p.sa_hi >= c.sa_hi AND p.depth < c.depth GROUP BY c.text_id, c.node_id)"""


def _values(words: tuple[str, ...]) -> str:
    return "p AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{w}')" for i, w in enumerate(words)) + ") AS v(pattern_id, pattern))"


def _near(d: int, texts: str = _PARTS, words: tuple[str, ...] = NEAR_WORDS) -> str:
    """All alignments, from the right."""
    return f"""
WITH RECURSIVE {texts}, {_values(words)},
near AS (SELECT *, 0 AS beg, unnest(range(0, length(text) + 1)) AS j FROM t, p WHERE len(list_filter(string_split(pattern, ''), lambda c: NOT contains(text, c))) = 0),
{_steps('near', d)}"""


def _steps(begun: str, d: int) -> str:
    """The alignments that end at given places ``j`` of a stretch of text from ``beg``, one edit a step."""
    return f"""
al AS (
  SELECT text_id, pattern_id, text, beg, pattern, length(pattern) AS i, j, 0 AS dist, '' AS edits FROM {begun}
  UNION ALL
  SELECT text_id, pattern_id, text, beg, pattern, i - (op <> 'D')::INT, j - (op <> 'I')::INT, dist + step, edits || op
  FROM (SELECT *, CASE WHEN op = 'M' THEN (substr(pattern, i, 1) <> substr(text, j, 1))::INT ELSE 1 END AS step
        FROM (SELECT *, unnest(['M', 'I', 'D']) AS op FROM al WHERE i > 0))
  WHERE dist + step <= {d} AND (op = 'I' OR j > 0) AND (op <> 'D' OR edits <> '')),
runs AS (SELECT text_id, pattern_id, CAST(beg + j AS BIGINT) AS pos, edits, dist FROM al WHERE i = 0),
out AS (SELECT *, array_to_string(list_transform(regexp_extract_all(edits, 'M+|I+|D+'), lambda r: length(r) || left(r, 1)), '') AS cigar,
  array_to_string(list_transform(regexp_extract_all(reverse(edits), 'M+|I+|D+'), lambda r: length(r) || left(r, 1)), '') AS cigar_fwd FROM runs)"""


_PLACED = """
reads AS (SELECT DISTINCT ord, name AS qname, seq FROM q WHERE seq <> ''),
seqs AS (SELECT ord, name AS rname, seq AS text FROM r WHERE seq <> ''),
win AS (SELECT ord, rname, text, pos, substr(text, pos + 1, 20) AS k FROM (SELECT *, unnest(range(0, length(text) - 19)) AS pos FROM seqs WHERE length(text) >= 20)),
hit AS (
  SELECT qname, rname, pos, seq FROM reads JOIN win ON left(seq, 20) = k WHERE length(seq) >= 20 AND substr(text, pos + 1, length(seq)) = seq
  UNION ALL SELECT qname, rname, pos, seq FROM (SELECT *, unnest(range(0, length(text) - length(seq) + 1)) AS pos FROM reads, seqs WHERE length(seq) < 20 AND contains(text, seq)) WHERE substr(text, pos + 1, length(seq)) = seq)
SELECT qname, rname, CAST(pos + 1 AS INT) AS pos, length(seq) || 'M' AS cigar, seq FROM hit"""


def _near_motifs() -> str:
    """The same with one edit for the stored patterns, begun only near a verbatim half of a pattern, on the stretch of text before each end."""
    return f"""
WITH RECURSIVE {_SEQUENCES},
half AS (
  SELECT pattern_id, pattern, 0 AS a, length(pattern) // 2 AS b FROM patterns
  UNION ALL SELECT pattern_id, pattern, length(pattern) // 2, length(pattern) FROM patterns),
size AS (SELECT DISTINCT b - a AS m FROM half),
win AS (SELECT text_id, text, pos, m, substr(text, pos + 1, m) AS w FROM (SELECT text_id, text, m, unnest(range(0, length(text) - m + 1)) AS pos FROM t, size WHERE length(text) >= m)),
ends AS (
  SELECT DISTINCT text_id, pattern_id, pattern, text, j FROM (
    SELECT text_id, pattern_id, pattern, text, unnest(range(pos + length(pattern) - a - 1, pos + length(pattern) - a + 2)) AS j
    FROM win JOIN half ON w = substr(pattern, a + 1, b - a))
  WHERE j BETWEEN 0 AND length(text) AND len(list_filter(string_split(pattern, ''), lambda c: NOT contains(text, c))) = 0),
near AS (SELECT text_id, pattern_id, pattern, j - greatest(0, j - length(pattern) - 1) AS j, greatest(0, j - length(pattern) - 1) AS beg, substr(text, greatest(0, j - length(pattern) - 1) + 1, j - greatest(0, j - length(pattern) - 1)) AS text FROM ends),
{_steps('near', 1)}"""


def oracle_sql() -> dict[str, str]:
    sub = lambda a, b: f"substr(text, {a} + 1, greatest(0, {b} - {a}))"
    n = "length(text)"
    return {
        "slice_index": f"WITH {_READS} SELECT text_id, CASE WHEN {n} > 2 THEN substr(text, 3, 1) END AS third, CASE WHEN {n} > 0 THEN right(text, 1) END AS last FROM t",
        "slice_prefix": f"WITH {_READS} SELECT text_id, left(text, 10) AS ten, left(text, greatest(0, {n} - 3)) AS but_three FROM t",
        "slice_suffix": f"WITH {_READS} SELECT text_id, substr(text, 6) AS from_five, right(text, 4) AS four FROM t",
        "slice_sub": f"WITH {_READS} SELECT text_id, {sub(f'least(3, {n})', f'greatest(0, {n} - 3)')} AS middle, {sub(f'greatest(0, {n} - 12)', f'greatest(0, {n} - 2)')} AS near_end FROM t",
        "slice_reverse": f"WITH {_READS} SELECT text_id, reverse(text) AS reversed FROM t",
        "slice_compare": f"WITH {_PAIRS} SELECT qname, x, y, x = y AS eq, x <= y AS le, x >= y AS ge FROM xy",
        "slice_lcp": f"WITH {_PAIRS} SELECT qname, x, y, CAST(list_max(list_filter(range(0, least(length(x), length(y)) + 1), lambda k: left(x, k) = left(y, k))) AS BIGINT) AS lcp FROM xy",
        "slice_format": f"WITH {_PARTS} SELECT text_id, '[' || array_to_string(string_split(text, ''), ', ') || ']' AS shown FROM t",
        "slice_array": f"WITH {_READS}, {_MAPPED} SELECT text_id, array_to_string(CASE WHEN len(codes) > 4 THEN codes[3:len(codes) - 2] ELSE [] END, ',') AS middle, CAST(codes[len(codes)] AS BIGINT) AS last, array_to_string(list_reverse(codes), ',') AS reversed FROM m",
        "buffer_append": f"WITH {_READS} SELECT text_id, text || 'ACGT' AS more, left(text, 4) || 'TT' AS cut_more FROM t",
        "text_length": f"WITH {_PAGES} SELECT text_id, CAST({n} AS BIGINT) AS n, CAST(strlen(text) AS BIGINT) AS bytes FROM t",
        "bitvector_matches": f"""WITH {_READS}, {_hits('A')},
            w AS (SELECT text_id, pos // 64 AS w, CAST(sum(CASE WHEN pos % 64 = 63 THEN -9223372036854775808 ELSE CAST(1 AS BIGINT) << CAST(pos % 64 AS INT) END) AS BIGINT) AS word FROM hits GROUP BY ALL),
            every AS (SELECT DISTINCT text_id, CAST(length(text) AS BIGINT) AS no_bits, unnest(range(0, (length(text) + 63) // 64)) AS w FROM t),
            joined AS (SELECT text_id, string_agg(CAST(coalesce(word, 0) AS VARCHAR), ',' ORDER BY w) AS words FROM every LEFT JOIN w USING (text_id, w) GROUP BY text_id)
            SELECT text_id, CAST(length(text) AS BIGINT) AS no_bits, coalesce(words, '') AS words FROM t LEFT JOIN joined USING (text_id)""",
        "bitvector_words": f"""WITH {_READS}, {_hits('A')},
            w AS (SELECT text_id, pos // 64 AS w, CAST(sum(CASE WHEN pos % 64 = 63 THEN -9223372036854775808 ELSE CAST(1 AS BIGINT) << CAST(pos % 64 AS INT) END) AS BIGINT) AS word FROM hits GROUP BY ALL),
            every AS (SELECT text_id, unnest(range(0, (length(text) + 63) // 64)) AS w FROM t),
            joined AS (SELECT text_id, string_agg(CAST(coalesce(word, 0) AS VARCHAR), ',' ORDER BY w) AS words FROM every LEFT JOIN w USING (text_id, w) GROUP BY text_id)
            SELECT text_id, CAST(length(text) AS BIGINT) AS no_bits, coalesce(words, '') AS words FROM t LEFT JOIN joined USING (text_id)""",
        "bitvector_set": f"""WITH {_READS}, {_BITS}, s AS (SELECT *, CASE WHEN n > 65 THEN '0' || substr(bits, 2, 64) || '1' || substr(bits, 67) WHEN n > 0 THEN '0' || substr(bits, 2) ELSE '' END AS put FROM b)
            SELECT text_id, CASE WHEN n > 7 THEN substr(bits, 8, 1) = '1' END AS eighth, '[' || rtrim(regexp_replace(put, '(.{{64}})', '\\1|', 'g'), '|') || ']' AS shown, n <= 2 OR substr(bits, 3, 1) = '1' AS third_set FROM s""",
        "bitvector_clear": f"WITH {_READS} SELECT text_id, '[' || rtrim(regexp_replace(repeat('0', {n}), '(.{{64}})', '\\1|', 'g'), '|') || ']' AS shown, true AS zero FROM t",
        "alphabet_build": f"WITH {_SEQUENCES}, {_SYMS} SELECT text_id, syms[i] AS sym, CAST(i AS INT) AS code FROM (SELECT text_id, syms, unnest(range(1, len(syms) + 1)) AS i FROM a)",
        "alphabet_map": f"WITH {_READS}, {_MAPPED} SELECT text_id, array_to_string(codes, ',') AS codes FROM m",
        "alphabet_roundtrip": f"WITH {_READS} SELECT text_id, text FROM t",
        "alphabet_unmappable": f"WITH {_READS} SELECT text_id, len(list_filter(['A', 'C', 'G', 'T', 'N'], lambda c: NOT contains(text, c))) > 0 AS unmappable FROM t",
        "exact_positions": f"WITH {_PAGES}, {_hits('en')} SELECT text_id, pos FROM hits",
        "exact_counts": f"WITH {_SEQUENCES}, {_hits('GATTA')} SELECT text_id, count(*) AS n FROM hits GROUP BY text_id",
        "exact_overlapping": f"WITH {_READS}, {_hits('AAA')} SELECT text_id, pos FROM hits",
        "exact_border": f"WITH {_READS}, {_hits('AATAA')}, {_hits('TTT').replace('hits AS', 'more AS')} SELECT text_id, CAST(0 AS BIGINT) AS pattern_id, pos FROM hits UNION ALL SELECT text_id, CAST(1 AS BIGINT), pos FROM more",
        "exact_linear": f"WITH {_PAGES}, {_hits('en')} SELECT text_id, pos FROM hits",
        "exact_multi_pattern": f"WITH {_SEQUENCES}, {_MATCHES} SELECT * FROM met",
        "exact_seed": f"WITH {_SEQUENCES}, {_MATCHES} SELECT * FROM met",
        "exact_missing": f"WITH {_SEQUENCES}, {_MATCHES} SELECT * FROM met EXCEPT SELECT text_id, pattern_id, pos FROM exact_matches",
        "exact_find_pages": f"WITH {_PAGES}, {_hits('qu')}, {_hits('ij').replace('hits AS', 'more AS')} SELECT text_id, CAST(0 AS BIGINT) AS pattern_id, pos FROM hits UNION ALL SELECT text_id, CAST(1 AS BIGINT), pos FROM more",
        "exact_bytes": f"WITH {_PAGES}, {_hits('é')}, {_hits('en').replace('hits AS', 'more AS')}, both_ AS (SELECT text_id, 0 AS pattern_id, pos FROM hits UNION ALL SELECT text_id, 1, pos FROM more) SELECT text_id, CAST(pattern_id AS BIGINT) AS pattern_id, CAST(strlen(left(text, pos)) AS BIGINT) AS pos FROM both_ JOIN t USING (text_id)",
        "border_array": "SELECT pattern_id, array_to_string(list_transform(range(1, length(pattern) + 1), lambda i: list_max(list_filter(range(0, i), lambda k: left(pattern, k) = right(left(pattern, i), k)))), ',') AS borders FROM patterns",
        "border_array_restricted": "SELECT pattern_id, array_to_string(list_transform(range(1, length(pattern) + 1), lambda i: list_max(list_filter(range(0, i), lambda k: k = 0 OR left(pattern, k) = right(left(pattern, i), k) AND (i = length(pattern) OR substr(pattern, k + 1, 1) <> substr(pattern, i + 1, 1))))), ',') AS restricted FROM patterns",
        "suffix_array": f"WITH {_SEQUENCES}, {_RANKS} SELECT text_id, rank, pos FROM sa",
        "suffix_array_doubling": f"WITH {_PARTS}, {_RANKS} SELECT text_id, rank, pos FROM sa",
        "suffix_array_inverse": f"WITH {_READS}, {_RANKS} SELECT text_id, pos, rank FROM sa",
        "lcp_array": f"""WITH {_READS}, {_RANKS}, pair AS (SELECT text_id, rank, suffix, coalesce(lag(suffix) OVER (PARTITION BY text_id ORDER BY rank), '') AS before FROM sa)
            SELECT text_id, rank, CAST(list_max(list_filter(range(0, least(length(suffix), length(before)) + 1), lambda k: left(suffix, k) = left(before, k))) AS BIGINT) AS lcp FROM pair""",
        "sl_types": f"WITH {_READS}, {_TYPES} SELECT text_id, pos, s_type FROM ty",
        "lms_positions": f"WITH {_READS}, {_TYPES}, l AS (SELECT text_id, pos, s_type, lag(s_type) OVER (PARTITION BY text_id ORDER BY pos) AS before FROM ty) SELECT text_id, pos FROM l WHERE s_type AND NOT before",
        "symbol_buckets": f"""WITH {_SEQUENCES}, {_SYMS},
            n AS (SELECT text_id, CAST(list_position(syms, c) AS INT) AS code, count(*) AS n FROM (SELECT text_id, syms, unnest(chars) AS c FROM a) GROUP BY ALL UNION ALL SELECT text_id, 0, 1 FROM t),
            e AS (SELECT text_id, code, n, CAST(sum(n) OVER (PARTITION BY text_id ORDER BY code) AS BIGINT) AS bucket_end FROM n)
            SELECT text_id, code, n, bucket_end - n AS bucket_beg, bucket_end FROM e""",
        "sa_search": f"WITH {_SEQUENCES}, {_RANKS}, {_MATCHES} SELECT text_id, pattern_id, rank, pos FROM met JOIN sa USING (text_id, pos)",
        "sa_search_indexed": f"WITH {_SEQUENCES}, {_RANKS}, {_MATCHES} SELECT text_id, pattern_id, rank, pos FROM met JOIN sa USING (text_id, pos)",
        "st_search_indexed": f"WITH {_PARTS}, {_values(TREE_WORDS)}, {_RANKS} SELECT text_id, pattern_id, rank, pos FROM sa, p WHERE starts_with(suffix, pattern)",
        "st_nodes_reads": f"""WITH {_READS}, {_NODES} SELECT num.text_id, num.node_id, parent_id, CAST(depth AS BIGINT) AS depth, CAST(sa.pos + coalesce(above, 0) AS BIGINT) AS edge_beg, CAST(sa.pos + depth AS BIGINT) AS edge_end, sa_lo, sa_hi, CAST(leaf_pos AS BIGINT) AS leaf_pos
            FROM num JOIN up ON up.text_id = num.text_id AND up.node_id = num.node_id JOIN sa ON sa.text_id = num.text_id AND sa.rank = sa_lo""",
        "approx_reads": f"{_near(1, _READS, READ_WORDS)} SELECT text_id, pattern_id, pos, edits, cigar, cigar_fwd, CAST(dist AS INT) AS dist FROM out",
        "st_nodes": f"""WITH {_PARTS}, {_NODES} SELECT num.text_id, num.node_id, parent_id, CAST(depth AS BIGINT) AS depth, CAST(sa.pos + coalesce(above, 0) AS BIGINT) AS edge_beg, CAST(sa.pos + depth AS BIGINT) AS edge_end, sa_lo, sa_hi, CAST(leaf_pos AS BIGINT) AS leaf_pos
            FROM num JOIN up ON up.text_id = num.text_id AND up.node_id = num.node_id JOIN sa ON sa.text_id = num.text_id AND sa.rank = sa_lo""",
        "st_leaves": f"WITH {_PARTS}, {_RANKS} SELECT text_id, rank, pos FROM sa",
        "st_locate": f"""WITH {_PARTS}, {_values(TREE_WORDS)}, {_RANKS},
            pairs AS (SELECT text_id, pattern_id, pattern, CAST(list_max(list_filter(range(0, length(pattern) + 1), lambda k: contains(text, left(pattern, k)))) AS BIGINT) AS matched FROM t, p),
            iv AS (SELECT text_id, pattern_id, min(rank) AS sa_lo, max(rank) + 1 AS sa_hi FROM sa, p WHERE starts_with(suffix, pattern) GROUP BY ALL)
            SELECT text_id, pattern_id, matched, matched = length(pattern) AS found, sa_lo, sa_hi FROM pairs LEFT JOIN iv USING (text_id, pattern_id)""",
        "st_search": f"WITH {_PARTS}, {_values(TREE_WORDS)}, {_RANKS} SELECT text_id, pattern_id, rank, pos FROM sa, p WHERE starts_with(suffix, pattern)",
        "bwt": f"WITH {_READS}, {_BWT} SELECT text_id, rank, code, ch FROM bwt",
        "bwt_reversed": f"WITH {_READS.replace('t AS', 'forth AS', 1)}, t AS (SELECT text_id, reverse(text) AS text FROM forth), {_BWT} SELECT text_id, rank, code, ch FROM bwt",
        "c_table": f"""WITH {_SEQUENCES}, {_SYMS},
            n AS (SELECT text_id, CAST(list_position(syms, c) AS INT) AS code, count(*) AS n FROM (SELECT text_id, syms, unnest(chars) AS c FROM a) GROUP BY ALL UNION ALL SELECT text_id, 0, 1 FROM t)
            SELECT text_id, code, CAST(sum(n) OVER (PARTITION BY text_id ORDER BY code) - n AS BIGINT) AS c FROM n""",
        "o_table": f"WITH {_READS}, {_BWT} SELECT text_id, rank, code, occ FROM os",
        "lf_mapping": f"WITH {_READS}, {_RANKS}, longer AS (SELECT text_id, pos - 1 AS before, rank FROM sa) SELECT l.text_id, l.rank, sa.rank AS lf FROM longer l JOIN t USING (text_id) JOIN sa ON sa.text_id = l.text_id AND sa.pos = CASE WHEN before < 0 THEN length(text) ELSE before END",
        "bwt_inverse": f"WITH {_SEQUENCES} SELECT text_id, text FROM t",
        "fm_search": f"WITH {_SEQUENCES}, {_MATCHES} SELECT * FROM met",
        "fm_search_indexed": f"WITH {_SEQUENCES}, {_RANKS}, {_MATCHES} SELECT text_id, pattern_id, rank, pos FROM met JOIN sa USING (text_id, pos)",
        "fm_index": f"WITH {_READS}, {_BWT} SELECT text_id, rank, pos, code, ch, occ, c FROM os JOIN cs USING (text_id, code)",
        "approx_d1": f"{_near(1)} SELECT text_id, pattern_id, pos, edits, cigar, cigar_fwd, CAST(dist AS INT) AS dist FROM out",
        "approx_d2": f"{_near(2)} SELECT text_id, pattern_id, pos, cigar, CAST(dist AS INT) AS dist FROM out",
        "approx_best": f"{_near(2)}, n AS (SELECT text_id, pattern_id, CAST(dist AS INT) AS dist, count(*) AS n, min(min(dist)) OVER (PARTITION BY text_id, pattern_id) AS least FROM out GROUP BY text_id, pattern_id, dist) SELECT text_id, pattern_id, dist, n FROM n WHERE dist = least",
        "approx_motifs": f"{_near_motifs()} SELECT text_id, pattern_id, pos, edits, cigar, cigar_fwd, CAST(dist AS INT) AS dist FROM out",
        "approx_indexed": f"{_near_motifs()} SELECT text_id, pattern_id, pos, edits, cigar, cigar_fwd, CAST(dist AS INT) AS dist FROM out",
        "cigar_encode": f"{_near(1)} SELECT text_id, pattern_id, pos, edits, cigar FROM out",
        "d_table": f"""
WITH RECURSIVE {_SEQUENCES},
walk AS (
  SELECT text_id, pattern_id, text, pattern, 0 AS i, 1 AS beg, 0 AS cuts, CAST([] AS INT[]) AS needed FROM t, patterns
  UNION ALL
  SELECT text_id, pattern_id, text, pattern, i + 1, CASE WHEN ok THEN beg ELSE i + 2 END, cuts + (NOT ok)::INT, list_append(needed, cuts + (NOT ok)::INT)
  FROM (SELECT *, contains(text, substr(pattern, beg, i + 2 - beg)) AS ok FROM walk WHERE i < length(pattern)))
SELECT text_id, pattern_id, array_to_string(needed, ',') AS needed FROM walk WHERE i = length(pattern)""",
        "fasta_records": _FASTA,
        "fastq_records": _FASTQ,
        "fasta_files": f"SELECT name, coalesce(seq, '') AS seq FROM ({_FASTA}) WHERE name <> ''",
        "fastq_files": f"SELECT name, coalesce(seq, '') AS seq, coalesce(qual, '') AS qual FROM ({_FASTQ}) WHERE name <> ''",
        "stream_matches": f"WITH t AS (SELECT ord AS text_id, {_clean_sql()} AS text FROM (SELECT ord, seq, row_number() OVER () AS copy FROM fastq) WHERE seq IS NOT NULL), {_hits('GATTACA')} SELECT text_id, CAST(0 AS BIGINT) AS pattern_id, pos FROM hits",
        "read_mapping_approx": f"""
WITH RECURSIVE q AS ({_FASTQ}), r AS ({_FASTA}),
reads AS (SELECT DISTINCT ord, name AS qname, seq FROM q WHERE seq <> ''),
pats AS (SELECT min(ord) AS pattern_id, seq AS pattern FROM reads GROUP BY seq),
seqs AS (SELECT ord AS text_id, name AS rname, seq AS text FROM r WHERE seq <> ''),
half AS (
  SELECT pattern_id, pattern, 0 AS a, length(pattern) // 2 AS b FROM pats WHERE length(pattern) >= 16
  UNION ALL SELECT pattern_id, pattern, length(pattern) // 2, length(pattern) FROM pats WHERE length(pattern) >= 16),
win AS (SELECT text_id, text, pos, substr(text, pos + 1, 8) AS k FROM (SELECT *, unnest(range(0, length(text) - 7)) AS pos FROM seqs WHERE length(text) >= 8)),
ends AS (
  SELECT DISTINCT text_id, pattern_id, pattern, text, j FROM (
    SELECT text_id, pattern_id, pattern, text, unnest(range(pos + length(pattern) - a - 1, pos + length(pattern) - a + 2)) AS j
    FROM win JOIN half ON k = substr(pattern, a + 1, 8) WHERE substr(text, pos + 1, b - a) = substr(pattern, a + 1, b - a)
    UNION ALL SELECT text_id, pattern_id, pattern, text, unnest(range(0, length(text) + 1)) FROM pats, seqs WHERE length(pattern) < 16)
  WHERE j BETWEEN 0 AND length(text) AND len(list_filter(list_distinct(string_split(pattern, '')), lambda c: NOT contains(text, c))) = 0),
near AS (SELECT text_id, pattern_id, pattern, j - greatest(0, j - length(pattern) - 1) AS j, greatest(0, j - length(pattern) - 1) AS beg, substr(text, greatest(0, j - length(pattern) - 1) + 1, j - greatest(0, j - length(pattern) - 1)) AS text FROM ends),
{_steps('near', 1)}
SELECT qname, rname, CAST(pos + 1 AS INT) AS pos, cigar_fwd AS cigar, seq FROM out JOIN pats USING (pattern_id) JOIN reads ON seq = pats.pattern JOIN seqs USING (text_id)""",
        "sam_lines": "SELECT concat_ws(chr(9), coalesce(qname, '*'), coalesce(rname, '*'), coalesce(pos, 0), coalesce(cigar, '*'), coalesce(seq, '*')) AS line FROM sam",
        "sam_placed": "SELECT DISTINCT * FROM sam WHERE qname IS NOT NULL AND rname <> '*' AND pos > 0 AND cigar <> '*'",
        "read_mapping_sam": f"WITH q AS ({_FASTQ}), r AS ({_FASTA}), {_PLACED}",
        "map_files_sam": f"WITH q AS (SELECT * FROM ({_FASTQ}) WHERE name <> ''), r AS (SELECT * FROM ({_FASTA}) WHERE name <> ''), {_PLACED}",
        "p4_found": f"""
WITH {_parsed()}
SELECT raw_id, CASE WHEN t IS NULL OR NOT regexp_full_match(t, '{_ROW}') THEN 'quoting' WHEN raw_id NOT IN (SELECT raw_id FROM cut) THEN 'columns' ELSE 'value' END AS reason
FROM row WHERE raw_id NOT IN (SELECT raw_id FROM good)""",
        "p4_fastq": f"WITH {_parsed()} SELECT raw_id, CAST(ord AS BIGINT) AS ord, name, seq, qual FROM good WHERE kind = 'fastq'",
        "p4_fasta": f"WITH {_parsed()} SELECT raw_id, CAST(ord AS BIGINT) AS ord, name, seq FROM good WHERE kind = 'fasta'",
    }
