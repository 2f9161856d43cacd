"""Queries of the operators for training data, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import langid, mixing, neardup, packing, shared, split, terms
from weftline.plans.lineage import cut
from weftline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _p6_checks(s: SparkSession, d: str) -> DataFrame:
    """What must hold of a packing: ``documents`` met, of which with tokens and never in two parts below the capacity, and no container above it."""
    docs, cap = table(s, d, "documents"), packing.CAPACITY
    rows = cut(packing.packed(docs))
    size = F.col("tok_end") - F.col("tok_beg")
    per = rows.groupBy("doc_id").agg(F.sum(size).alias("tokens"), F.count("*").alias("parts"), F.count("container_id").alias("placed"), F.max("tok_end").alias("upto"))
    wrong = (F.col("upto") != F.col("tokens")) | (F.col("parts") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / cap))) | (F.col("placed") != F.when(F.col("tokens") > 0, F.col("parts")).otherwise(0))
    over = rows.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum(size).alias("tokens")).agg(F.count_if(F.col("tokens") > cap).alias("over"))
    # Within 1 % of the least number of containers, and one more for the last.
    fill = packing.fill_report(rows).select((F.col("containers") <= F.col("least_containers") * 1.01 + 1).alias("tight"))
    found = per.agg(F.count("*").alias("documents"), F.count_if(wrong).alias("wrong"))
    return found.withColumn("over", over.scalar()).withColumn("tight", fill.scalar())


def _p7_checks(s: SparkSession, d: str) -> DataFrame:
    """``source, held, cap_kept, share_kept`` of every target: whether its source has documents, no document is used too often and its share is reached."""
    targets = table(s, d, "mix_targets")
    mix = cut(mixing.mixed(table(s, d, "documents"), targets))
    report = mixing.share_report(mix, targets).withColumn("held", F.col("available") > 0)
    present, total, largest = (x.scalar() for x in (report.where("held").agg(F.sum("target_share")), report.agg(F.sum("tokens")), mix.agg(F.max("tokens"))))
    # Within 0.2 % of the mix and one document, as documents are whole.
    off = F.abs(F.col("tokens") - F.when(F.col("held"), F.col("target_share")).otherwise(0.0) / present * total)
    return report.select("source", "held", (F.col("most_copies") <= F.col("max_repeat")).alias("cap_kept"), (off <= 0.002 * total + largest).alias("share_kept"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: split.gaps(table(s, d, "fasta")),
        "p1_pieces": lambda s, d: split.pieces(table(s, d, "fasta")),
        "p2_found": lambda s, d: shared.shared_spans(table(s, d, "fasta")),
        "p2_shared": lambda s, d: shared.shared_parts(table(s, d, "fasta")).select("ord", "name", "clean_len", "shared_len", "shared_part", F.size("spans").alias("n_spans"), F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["span_beg"].cast("string"), x["span_end"].cast("string"))), ",").alias("spans")),
        "p3_found": lambda s, d: neardup.record_pairs(table(s, d, "fastq")),
        "p3_groups": lambda s, d: neardup.groups(table(s, d, "fastq")),
        "p5_found": lambda s, d: terms.marked_terms(table(s, d, "fastq")).where("mark IS NOT NULL").select("term", "mark"),
        "p5_terms": lambda s, d: terms.marked_terms(table(s, d, "fastq")),
        "p6_packed": lambda s, d: packing.packed(table(s, d, "documents")),
        "p6_fill": lambda s, d: packing.fill_report(packing.packed(table(s, d, "documents"))),
        "p6_checks": _p6_checks,
        "p7_mix": lambda s, d: mixing.mixed(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p7_shares": lambda s, d: mixing.share_report(mixing.mixed(table(s, d, "documents"), table(s, d, "mix_targets")), table(s, d, "mix_targets")),
        "p7_checks": _p7_checks,
        "p8_found": lambda s, d: langid.relabelled(table(s, d, "documents"), table(s, d, "lang_samples")),
        "p8_languages": lambda s, d: langid.languages(table(s, d, "documents"), table(s, d, "lang_samples")),
    }


_CLEAN = "upper(regexp_replace(seq, '[ \\t\\r\\n]', '', 'g'))"
_FASTA = f"rec AS (SELECT DISTINCT ord, {_CLEAN} AS s FROM fasta WHERE seq IS NOT NULL)"
_READS = f"rec AS (SELECT DISTINCT ord, {_CLEAN} AS s FROM fastq WHERE seq IS NOT NULL)"

_SPANS = f"""
{_FASTA},
win AS (SELECT ord, s, unnest(range(0, length(s) - 63)) AS pos FROM rec WHERE length(s) >= 64),
key AS (SELECT ord, pos, substr(s, pos + 1, 64) AS w FROM win),
good AS (SELECT * FROM key WHERE w NOT SIMILAR TO '.*[^ACGT].*'),
met AS (SELECT w FROM good GROUP BY w HAVING min(ord) <> max(ord)),
hit AS (SELECT ord, pos FROM good JOIN met USING (w)),
mark AS (SELECT ord, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY ord ORDER BY pos) <= 64 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT ord, pos, sum(new) OVER (PARTITION BY ord ORDER BY pos) AS run FROM mark),
span AS (SELECT ord, min(pos) AS span_beg, max(pos) + 64 AS span_end FROM run GROUP BY ord, run)
"""

# Pairs of reads by the windows they share.
_LIKE = f"""
{_READS},
win AS (SELECT DISTINCT ord, substr(s, pos + 1, 8) AS w FROM (SELECT ord, s, unnest(range(0, length(s) - 7)) AS pos FROM rec WHERE length(s) >= 8)),
n AS (SELECT ord, count(*) AS n FROM win GROUP BY ord),
common AS (SELECT x.ord AS ord_a, y.ord AS ord_b, count(*) AS k FROM win x JOIN win y USING (w) WHERE x.ord < y.ord GROUP BY ALL),
pairs AS (SELECT ord_a, ord_b FROM common JOIN n x ON x.ord = ord_a JOIN n y ON y.ord = ord_b WHERE 2 * k >= x.n + y.n - k)
"""

_TERMS = f"""
{_READS},
win AS (SELECT ord, substr(s, pos + 1, 10) AS term FROM (SELECT ord, s, unnest(range(0, length(s) - 9)) AS pos FROM rec WHERE length(s) >= 10)),
freq AS (SELECT term, count(*) AS occurrences, count(DISTINCT ord) AS records FROM win WHERE regexp_full_match(term, '[ACGT]+') GROUP BY term),
marked AS (SELECT term, occurrences, records, CASE WHEN records = 1 THEN 'rare' WHEN records * 40 >= (SELECT count(*) FROM rec) THEN 'common' END AS mark FROM freq)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""
WITH {_FASTA},
long AS (SELECT ord, s FROM rec WHERE length(s) > 2000),
part AS (SELECT ord, unnest(regexp_extract_all(s, '[ACGT]+|[^ACGT]+')) AS piece, generate_subscripts(regexp_extract_all(s, '[ACGT]+|[^ACGT]+'), 1) AS i FROM long),
cuts AS (SELECT ord, piece, sum(length(piece)) OVER (PARTITION BY ord ORDER BY i) AS e FROM part),
gap AS (SELECT ord, CAST(e - length(piece) AS BIGINT) AS gap_beg, CAST(e AS BIGINT) AS gap_end FROM cuts WHERE length(piece) >= 10 AND regexp_matches(piece, '^[^ACGT]'))
SELECT * FROM gap UNION ALL SELECT ord, CAST(-1 AS BIGINT), CAST(-1 AS BIGINT) FROM long WHERE ord NOT IN (SELECT ord FROM gap)""",
        "p1_pieces": f"""
WITH RECURSIVE {_FASTA},
part AS (SELECT ord, unnest(regexp_extract_all(s, '[ACGT]+|[^ACGT]+')) AS piece, generate_subscripts(regexp_extract_all(s, '[ACGT]+|[^ACGT]+'), 1) AS i FROM rec),
cuts AS (SELECT ord, piece, sum(length(piece)) OVER (PARTITION BY ord ORDER BY i) AS e FROM part),
gap AS (SELECT ord, list({{'b': e - length(piece), 'e': e}}) AS g FROM cuts WHERE length(piece) >= 10 AND regexp_matches(piece, '^[^ACGT]') GROUP BY ord),
walk AS (
  SELECT ord, length(s) AS n, coalesce(g, []) AS g, -1 AS no, 0 AS beg, 100 AS fin, false AS at_gap FROM rec LEFT JOIN gap USING (ord) WHERE s <> ''
  UNION ALL
  SELECT ord, n, g, no + 1, b, CASE WHEN b + 2000 >= n THEN n WHEN stop > b + 100 THEN stop ELSE b + 2000 END, b + 2000 < n AND stop > b + 100
  FROM (SELECT *, fin - 100 AS b, coalesce(list_max(list_transform(list_filter(g, lambda x: x.b <= fin + 1900), lambda x: least(x.e, fin + 1900))), -1)::BIGINT AS stop FROM walk WHERE no < 0 OR fin < n))
SELECT ord, CAST(no AS BIGINT) AS piece_no, CAST(beg AS BIGINT) AS piece_beg, CAST(fin AS BIGINT) AS piece_end, at_gap, substr(s, beg + 1, fin - beg) AS piece FROM walk JOIN rec USING (ord) WHERE no >= 0""",
        "p2_found": f"WITH {_SPANS} SELECT ord, CAST(span_beg AS BIGINT) AS span_beg, CAST(span_end AS BIGINT) AS span_end FROM span",
        "p2_shared": f"""
WITH {_SPANS},
every AS (SELECT DISTINCT ord, name, CAST(length({_CLEAN}) AS BIGINT) AS clean_len FROM fasta),
part AS (SELECT ord, sum(span_end - span_beg) AS shared_len, count(*) AS n_spans, string_agg(span_beg || '-' || span_end, ',' ORDER BY span_beg) AS spans FROM span GROUP BY ord)
SELECT ord, name, clean_len, CAST(coalesce(shared_len, 0) AS BIGINT) AS shared_len, CASE WHEN clean_len > 0 THEN coalesce(shared_len, 0)::DOUBLE / clean_len END AS shared_part, coalesce(spans, '') AS spans, CAST(coalesce(n_spans, 0) AS INT) AS n_spans FROM every LEFT JOIN part USING (ord)""",
        "p3_found": f"WITH {_LIKE} SELECT ord_a, ord_b FROM pairs",
        "p3_groups": f"""
WITH RECURSIVE {_LIKE},
text AS (SELECT ord, min(ord) OVER (PARTITION BY s) AS rep FROM rec WHERE s <> ''),
edge AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM pairs JOIN text x ON x.ord = ord_a JOIN text y ON y.ord = ord_b WHERE x.rep <> y.rep),
way AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT a AS rep, a AS node FROM way UNION SELECT rep, b FROM reach JOIN way ON a = node),
grp AS (SELECT rep, min(node) AS group_id FROM reach GROUP BY rep),
deg AS (SELECT a AS rep, count(DISTINCT b) AS links FROM way GROUP BY a)
SELECT ord, rep, coalesce(group_id, rep) AS group_id, coalesce(links, 0) AS links FROM text LEFT JOIN grp USING (rep) LEFT JOIN deg USING (rep)""",
        "p6_checks": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS wrong, CAST(0 AS BIGINT) AS over, true AS tight FROM documents",
        "p7_checks": "SELECT source, EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND text <> '') AS held, true AS cap_kept, true AS share_kept FROM mix_targets t WHERE target_share > 0",
        "p5_found": f"WITH {_TERMS} SELECT term, mark FROM marked WHERE mark IS NOT NULL",
        "p5_terms": f"WITH {_TERMS} SELECT * FROM marked",
    }
