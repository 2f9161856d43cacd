"""Approximate matching within ``d`` edits, with the edits of every alignment.

For each text and pattern the result is the set of all (start, edits) such that
the edits, read from the pattern's end to its start, align the whole pattern:
``M`` pairs a symbol with a symbol (equal or not), ``I`` consumes the pattern
only, ``D`` the text only. Mismatches, ``I`` and ``D`` cost 1 each and at most
``d`` in all; an alignment neither starts nor ends with ``D``. ``cigar`` is the
run-length form in this order, ``cigar_fwd`` from the pattern's start.

Of a pattern cut into ``d + 1`` parts, one stands verbatim in every occurrence,
so only places near such a part are aligned; alignments are then enumerated
with the cost bound. The work grows steeply with ``d``.

``strategy="seed"`` is for pattern tables too large to be sent to every worker: the
parts meet the texts by the seed join of ``exact``, every place where an
alignment may end is looked at once, with the stretch of text before it, and no
task holds a pattern table. It needs each ``text_id`` and each ``pattern_id`` once,
and rows of patterns without a ``pattern_id`` take no part in it.

Results for odd input: null texts and patterns take no part; a pattern with a
symbol that the text does not have has no match, whatever ``d``; a pattern of at
most ``d`` symbols, the empty one included, matches by insertions at all
``n + 1`` positions; repeated rows of texts repeat their rows; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.exact import BLOCK, SEED, _text_blocks, by_seed, find_all
from weftline.operators.pattern_blocks import over_blocks
from weftline.plans.lineage import cut

SCHEMA = "text_id bigint, pattern_id bigint, pos bigint, edits string, cigar string, cigar_fwd string, dist int"
_ARROW = pa.schema([("text_id", pa.int64()), ("pattern_id", pa.int64()), ("pos", pa.int64()), ("edits", pa.string()), ("cigar", pa.string()), ("cigar_fwd", pa.string()), ("dist", pa.int32())])
ROWS = 1 << 15


def run_lengths(edits: str) -> str:
    """``MMID`` as ``2M1I1D``."""
    out, at = [], 0
    while at < len(edits):
        to = at
        while to < len(edits) and edits[to] == edits[at]:
            to += 1
        out.append(f"{to - at}{edits[at]}")
        at = to
    return "".join(out)


def cigar(edits: Column) -> Column:
    """The same as a column expression."""
    runs = F.regexp_extract_all(edits, F.lit("(M+|I+|D+)"))
    return F.when(edits.isNotNull(), F.array_join(F.transform(runs, lambda r: F.concat(F.length(r).cast("string"), F.left(r, F.lit(1)))), ""))


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def ends_near(x: str, p: str, d: int) -> list[int]:
    """Ends at which an alignment may lie: near a verbatim part of the pattern, or anywhere if a part is empty."""
    n, m = len(x), len(p)
    if m <= d:
        return [*range(n + 1)]
    cuts = [m * i // (d + 1) for i in range(d + 2)]
    ends: set[int] = set()
    for a, b in zip(cuts, cuts[1:]):
        for at in find_all(x, p[a:b]):
            right = at + m - a
            ends.update(range(max(0, right - d), min(n, right + d) + 1))
    return sorted(ends)


def alignments(x: str, p: str, d: int) -> Iterator[tuple[int, str, int]]:
    """Start, edits from the right, and cost of all alignments."""
    if any(c not in x for c in set(p)):
        return
    yield from alignments_at(x, p, d, ends_near(x, p, d))


def alignments_at(x: str, p: str, d: int, ends: list[int]) -> Iterator[tuple[int, str, int]]:
    """The same of those that end at given places."""
    for end in ends:
        todo = [(len(p), end, 0, "")]
        while todo:
            i, j, cost, edits = todo.pop()
            if i == 0:
                # Nothing of the pattern is left, so what ends here does not end with D.
                yield j, edits, cost
                continue
            if j:
                worse = cost + (p[i - 1] != x[j - 1])
                if worse <= d:
                    todo.append((i - 1, j - 1, worse, edits + "M"))
            if cost < d:
                todo.append((i - 1, j, cost + 1, edits + "I"))
                if edits and j:
                    todo.append((i, j - 1, cost + 1, edits + "D"))


def _letters(c: str) -> Column:
    return F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))


def _parts(patterns: DataFrame, d: int) -> DataFrame:
    """``pattern_id, m, needs, shift, part``: the ``d + 1`` parts of each pattern with its length and symbols; a part begins ``shift`` symbols before the end of its pattern."""
    cut_at = lambda i: F.floor(F.length("pattern") * i / (d + 1)).cast("int")
    parts = F.array(*(F.struct((F.length("pattern") - cut_at(i)).alias("shift"), F.substring("pattern", cut_at(i) + 1, cut_at(i + 1) - cut_at(i)).alias("part")) for i in range(d + 1)))
    return patterns.select("pattern_id", F.length("pattern").alias("m"), _letters("pattern").alias("needs"), F.inline(parts))


def approx_by_seed(texts: DataFrame, patterns: DataFrame, d: int, unique: bool = False) -> DataFrame:
    """``approx_matches`` by the seed join; ``unique``: the patterns are distinct and written already. Patterns too short for seeds go in blocks."""
    texts = texts.select("text_id", "text").where("text IS NOT NULL")
    if not unique:
        patterns = cut(patterns.select("pattern_id", "pattern").where("pattern IS NOT NULL").distinct())
    long_ = F.length("pattern") >= SEED * (d + 1)
    some = patterns.where(long_)
    parts = _parts(some, d)
    # Equal parts are looked for once. Two with one hash only add places, as alignments are made from the texts.
    words = cut(parts.groupBy("part").agg(F.count("*")).select(F.xxhash64("part").alias("pattern_id"), F.col("part").alias("pattern")))
    hits = by_seed(texts, words, unique=True).withColumnRenamed("pattern_id", "word")
    near = hits.join(parts.select("pattern_id", "m", "needs", "shift", F.xxhash64("part").alias("word")), "word")
    ends = F.sequence(F.col("pos") + F.col("shift") - d, F.col("pos") + F.col("shift") + d)
    places = near.select("text_id", "pattern_id", "m", "needs", F.explode(ends).alias("stop")).where("stop >= 0").distinct()
    has = texts.select(F.col("text_id").alias("_t"), _letters("text").alias("letters"))
    known = places.join(has, F.col("text_id").eqNullSafe(F.col("_t"))).where(F.size(F.array_except("needs", "letters")) == 0)
    known = known.select("text_id", "pattern_id", "stop", F.greatest(F.lit(0), F.col("stop") - F.col("m") - d).alias("begin"))
    longest = some.agg(F.max(F.length("pattern"))).first()[0] or 0
    block = max(BLOCK, 8 * (longest + d))
    stretches = texts.mapInArrow(_text_blocks(block, longest + d), "text_id bigint, block_no bigint, part string").select(F.col("text_id").alias("_t"), F.col("block_no").alias("_b"), F.col("part").alias("stretch"))
    same = F.col("text_id").eqNullSafe(F.col("_t")) & (F.floor(F.col("begin") / block) == F.col("_b"))
    window = F.substring("stretch", (F.col("begin") % block + 1).cast("int"), (F.col("stop") - F.col("begin")).cast("int"))
    met = known.join(stretches, same).select("text_id", "pattern_id", "begin", "stop", window.alias("window"))
    # A place behind the end of its text has a shorter window.
    ready = met.where(F.length("window") == F.col("stop") - F.col("begin")).join(some, "pattern_id").select("text_id", "pattern_id", "pattern", "begin", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for t, k, p, begin, window in zip(*(c.to_pylist() for c in batch.columns)):
                for pos, edits, cost in alignments_at(window, p, d, [len(window)]):
                    rows.append((t, k, begin + pos, edits, run_lengths(edits), run_lengths(edits[::-1]), cost))
                    if len(rows) >= ROWS:
                        yield as_batch(rows)
                        rows = []
        if rows:
            yield as_batch(rows)

    return ready.mapInArrow(run, SCHEMA).union(approx_matches(texts, patterns.where(~long_), d))


def approx_matches(texts: DataFrame, patterns: DataFrame, d: int, strategy: str = "blocks") -> DataFrame:
    """``text_id, pattern_id, pos, edits, cigar, cigar_fwd, dist`` of all alignments with at most ``d`` edits."""
    if strategy == "seed":
        return approx_by_seed(texts, patterns, d)

    def one(texts: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        shared = texts.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            short = lru_cache(4096)(lambda x, p: [*alignments(x, p, d)])  # short texts are often repeated
            for batch in batches:
                for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for k, p in shared.value:
                        for pos, edits, cost in short(x, p) if len(x) < 64 else alignments(x, p, d):
                            rows.append((t, k, pos, edits, run_lengths(edits), run_lengths(edits[::-1]), cost))
                            if len(rows) >= ROWS:
                                yield as_batch(rows)
                                rows = []
            if rows:
                yield as_batch(rows)

        return texts.mapInArrow(run, SCHEMA)

    return over_blocks(texts.select("text_id", "text").where("text IS NOT NULL"), patterns, one)


def best_matches(texts: DataFrame, patterns: DataFrame, d: int) -> DataFrame:
    """``text_id, pattern_id, dist, n``: the least number of edits of each pattern in each text, and how many alignments have it."""
    found = approx_matches(texts, patterns, d)
    n = found.groupBy("text_id", "pattern_id", "dist").agg(F.count("*").alias("n"))
    least = F.min("dist").over(Window.partitionBy("text_id", "pattern_id"))
    return n.withColumn("least", least).where("dist = least").select("text_id", "pattern_id", "dist", "n")


def edits_needed(x: str, p: str) -> list[int]:
    """For each prefix of the pattern a lower bound of its edits: how often it must be cut for all parts to stand in the text."""
    out, cuts, begin = [], 0, 0
    for i in range(len(p)):
        if p[begin : i + 1] not in x:
            cuts += 1
            begin = i + 1
        out.append(cuts)
    return out


def needed_edits(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``text_id, pattern_id, needed`` (an array by pattern position)."""

    def one(texts: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        shared = texts.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(t, k, edits_needed(x, p)) for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, p in shared.value]
                if rows:
                    a, b, c = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.list_(pa.int32()))], names=["text_id", "pattern_id", "needed"])

        return texts.mapInArrow(run, "text_id bigint, pattern_id bigint, needed array<int>")

    return over_blocks(texts.select("text_id", "text").where("text IS NOT NULL"), patterns, one)
