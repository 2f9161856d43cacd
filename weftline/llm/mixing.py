"""Problem 7: a mix of sources with target shares of tokens, by entropy balancing.

Every document of a source with a target gets a rate, the expected number of
its uses. Rates stay as close as possible (in relative entropy) to using each
document once, under the constraint that the tokens of source s come to
``share_s * total`` and no rate exceeds ``max_repeat``. The solution of the
convex dual is an exponential tilt, ``rate = min(max_repeat, exp(x_s * tokens / mean_s))``,
with one ``x_s`` per source, found by Newton steps (on the logarithm of the
tokens) that are kept within a bracket. Documents enter the steps only through counts by source and size,
written once; each step is one aggregation and returns one row per source.

Rates become whole uses size by size, from the largest: each size makes up for
the tokens owed so far, so the tokens reached differ from the constraint by
about the smallest document. This goes over the sizes of a source, not over its
documents. Which documents of one size get one use more is by hash, ranked
within salted parts, so that no task ranks all of a source.

``total`` defaults to the largest size at which every source with a target and
documents can hold its share; shares of sources without documents fall to the
others in proportion. With a larger ``total`` a source ends at its cap, and the
report says so.

Results for odd input: null and empty texts have no tokens and are not used;
documents without a source or whose source has no target have 0 copies; null
shares and shares of 0 are no target; a null ``max_repeat`` counts as 1; of
repeated targets of a source the greatest share counts; further columns are
ignored.
"""

from __future__ import annotations

import math
import warnings

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.llm.tokens import TOKENIZER, sized
from weftline.plans.lineage import cut

SALTS, STEPS, EXACT = 32, 60, 1e-6
SOLVED = T.StructType([T.StructField(c, t) for c, t in (("source", T.StringType()), ("x", T.DoubleType()), ("mean", T.DoubleType()), ("cap", T.IntegerType()))])


def _targets(targets: DataFrame) -> DataFrame:
    one = targets.where("target_share > 0 AND source IS NOT NULL").groupBy("source").agg(F.max(F.struct("target_share", F.coalesce("max_repeat", F.lit(1)).alias("cap"))).alias("t"))
    return one.select("source", "t.target_share", F.greatest("t.cap", F.lit(0)).alias("cap")).where("cap > 0")


def _rate(x: Column) -> Column:
    """The tilted rate; the exponent is bounded well beyond any cap."""
    return F.least(F.col("cap").cast("double"), F.exp(F.least(F.lit(50.0), F.greatest(F.lit(-700.0), x * F.col("tokens") / F.col("mean")))))


def solve(cells: DataFrame, total: float | None) -> dict[str, tuple[float, float, int]]:
    """``x``, mean size and cap of each source. ``cells``: ``source, target_share, cap, tokens, n``.

    What the driver holds is one entry per source of the target table.
    """
    size = F.col("n") * F.col("tokens")
    own = {r["source"]: r for r in cells.groupBy("source").agg(F.first("target_share").alias("share"), F.first("cap").alias("cap"), F.sum("n").alias("docs"), F.sum(size).alias("sum")).collect()}
    whole = sum(r["share"] for r in own.values())
    if total is None:
        total = min((r["sum"] * r["cap"] / (r["share"] / whole) for r in own.values()), default=0.0)
    want = {s: min(r["share"] / whole * total, float(r["sum"] * r["cap"])) for s, r in own.items()}
    # The rate that all documents of a source would need is where its steps begin.
    x = {s: math.log(want[s] / r["sum"]) for s, r in own.items()}
    low, high, done = dict.fromkeys(own, -700.0), dict.fromkeys(own, math.inf), set()
    for s, r in own.items():
        if want[s] >= r["sum"] * r["cap"] * (1 - EXACT):  # all documents at the cap
            x[s] = math.inf
            done.add(s)
    session = cells.sparkSession
    for _ in range(STEPS):
        if len(done) == len(own):
            break
        now = session.createDataFrame([(s, v, own[s]["sum"] / own[s]["docs"], own[s]["cap"]) for s, v in x.items() if s not in done], SOLVED)
        rate = _rate(F.col("x"))
        slope = F.when(rate < F.col("cap"), size * rate * F.col("tokens") / F.col("mean")).otherwise(0.0)
        got = cells.drop("cap").join(now, "source").groupBy("source").agg(F.sum(size * rate).alias("f"), F.sum(slope).alias("d")).collect()
        for r in got:
            s, off = r["source"], r["f"] - want[r["source"]]
            if abs(off) <= EXACT * want[s]:
                done.add(s)
                continue
            if off > 0:
                high[s] = x[s]
            else:
                low[s] = x[s]
            # Newton on the logarithm of the tokens, which is nearly straight in x.
            step = x[s] - math.log(r["f"] / want[s]) * r["f"] / r["d"] if r["d"] > 0 else math.nan
            if not low[s] < step < high[s]:
                step = (low[s] + high[s]) / 2 if high[s] < math.inf else max(1.0, 2 * x[s])
            x[s] = step
    if len(done) < len(own):
        warnings.warn(f"shares not solved to {EXACT} in {STEPS} steps: {sorted(set(own) - done)}", stacklevel=2)
    return {s: (min(x[s], 1e9), own[s]["sum"] / own[s]["docs"], own[s]["cap"]) for s in own}


def _rounded(table: pa.Table) -> pa.Table:
    """Uses of all documents of one size, for the sizes of one source from the largest: each makes up for the tokens owed so far."""
    table = table.sort_by([("tokens", "descending")])
    size, n, cap, rate = (table.column(c).to_numpy() for c in ("tokens", "n", "cap", "rate"))
    owed, uses = 0.0, []
    for t, k, c, r in zip(size.tolist(), n.tolist(), cap.tolist(), rate.tolist()):
        owed += t * k * r
        m = min(k * c, max(0, math.floor(owed / t + 0.5)))
        owed -= m * t
        uses.append(m)
    return pa.table([table.column("source"), size, n, pa.array(uses, pa.int64())], names=["source", "tokens", "n", "uses"])


def mixed(docs: DataFrame, targets: DataFrame, total: float | None = None, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, tokens, copies`` of every document; ``copies`` is 0 for those left out."""
    kept = docs.select("doc_id", "source", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("spread"))
    sizes = cut(sized(kept, ["doc_id", "source", "spread"], path=path))
    salt = (F.col("spread") % SALTS).alias("salt")
    goal = _targets(targets)
    used = sizes.where("tokens > 0 AND source IS NOT NULL")
    # Counts by source, size and salt: bounded by the sizes a document can have, not by the documents.
    cells = cut(used.groupBy("source", "tokens", salt).agg(F.count("*").alias("n")).join(goal, "source"))
    solved = solve(cut(cells.groupBy("source", "target_share", "cap", "tokens").agg(F.sum("n").alias("n"))), total)
    tilt = sizes.sparkSession.createDataFrame([(s, *v) for s, v in solved.items()], SOLVED)
    every = cells.groupBy("source", "tokens", "cap").agg(F.sum("n").alias("n"))
    rated = every.join(tilt.drop("cap"), "source").select("source", "tokens", "cap", "n", _rate(F.col("x")).alias("rate"))
    uses = rated.groupBy("source").applyInArrow(_rounded, "source string, tokens bigint, n bigint, uses bigint")
    # A document's rank within its source and size: its rank within the salt after the sizes of the salts before.
    w = Window.partitionBy("source", "tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select("source", "tokens", "salt", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("source", "tokens", "salt").orderBy("spread", "doc_id"))
    ranked = sizes.select("doc_id", "source", "spread", "tokens", salt).withColumn("rank", rank)
    known = before.join(uses, ["source", "tokens"])
    whole, rest = F.floor(F.col("uses") / F.col("n")), F.col("uses") % F.col("n")
    copies = F.coalesce(whole + (F.col("before") + F.col("rank") <= rest).cast("int"), F.lit(0).cast("bigint"))
    return ranked.join(known, ["source", "tokens", "salt"], "left").select("doc_id", "source", "tokens", copies.alias("copies"))


def share_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeat, reached_share, tokens, documents, most_copies, available`` of every source with a target.

    ``available`` is what the source holds, each document once: what a scarce source makes the others leave out.
    """
    goal = _targets(targets).select("source", "target_share", F.col("cap").alias("max_repeat"))
    got = mix.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.count_if(F.col("copies") > 0).alias("documents"), F.max("copies").alias("most_copies"), F.sum("tokens").alias("available"))
    zero = F.lit(0).cast("bigint")
    full = goal.join(got, "source", "left").select("source", "target_share", "max_repeat", *(F.coalesce(c, zero).alias(c) for c in ("tokens", "documents", "most_copies", "available")))
    return full.withColumn("reached_share", F.coalesce(F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy())), F.lit(0.0)))
