"""Exact matching: every occurrence of every pattern, overlapping ones included.

``texts(text_id, text)`` and ``patterns(pattern_id, pattern)`` give
``matches(text_id, pattern_id, pos)`` with 0-based code-point positions. The
strategies differ in cost, not in answer:

* ``automaton``: one pass per text for a whole block of patterns (the default);
* ``scan``: built-in expressions only;
* ``find``: the run-time's substring search per text and pattern;
* ``border``, ``kmp``: linear matchers on border arrays;
* ``seed``: an equi-join on the pattern's first symbols, for pattern tables too
  large to be sent to every worker.

Results for odd input: null texts and patterns take no part; an empty pattern
has no occurrence (index searches differ, see ``suffix``); repeated rows of
texts give their matches as often; repeated patterns count once; further
columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.binding import let, total
from weftline.functions.sequences import symbols
from weftline.operators.pattern_blocks import over_blocks
from weftline.plans.lineage import cut

SEED, BLOCK, FILTER = 16, 1 << 11, 1 << 26
SCHEMA = "text_id bigint, pattern_id bigint, pos bigint"
_SCHEMA = pa.schema([(c, pa.int64()) for c in ("text_id", "pattern_id", "pos")])
ROWS = 1 << 16


# --- borders ---------------------------------------------------------------


def restricted_borders(p: str) -> list[int]:
    """For every prefix the longest border after which the next symbol differs from the one that follows the prefix; the last prefix has its border.

    The stretch from place ``at`` that equals a beginning of ``p`` and can't be made longer is such a border of the prefix that
    it ends; the first place gives the longest.
    """
    n, out = len(p), [0] * len(p)
    same, at, upto = [0] * n, 0, 0  # the stretch of each place, and the one that reaches furthest
    for i in range(1, n):
        k = min(same[i - at], upto - i) if i < upto else 0
        while i + k < n and p[k] == p[i + k]:
            k += 1
        same[i] = k
        if i + k > upto:
            at, upto = i, i + k
        if k and not out[i + k - 1]:
            out[i + k - 1] = k
    return out


def borders(p: str) -> list[int]:
    """For every prefix of ``p`` the length of its longest proper border: a restricted one, or that of the next prefix less one symbol."""
    out = restricted_borders(p)
    for i in range(len(p) - 2, 0, -1):
        out[i] = max(out[i], out[i + 1] - 1)
    return out


def border_arrays(patterns: DataFrame) -> DataFrame:
    """``pattern_id, borders, restricted`` of every row; null for a null pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        for batch in batches:
            ps = batch.column(1).to_pylist()
            arrays = [pa.array([None if p is None else f(p) for p in ps], kind) for f in (borders, restricted_borders)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["pattern_id", "borders", "restricted"])

    return patterns.select("pattern_id", "pattern").mapInArrow(run, "pattern_id bigint, borders array<int>, restricted array<int>")


# --- matchers of one text and one pattern ----------------------------------


def find_all(x: str, p: str) -> list[int]:
    out, at = [], x.find(p) if p else -1
    while at >= 0:
        out.append(at)
        at = x.find(p, at + 1)
    return out


def _by_border(x: str, p: str, fall: list[int], full: int) -> list[int]:
    out, k, m = [], 0, len(p)
    for i, c in enumerate(x):
        while k and (k == m or p[k] != c):
            k = full if k == m else fall[k - 1]
        if p[k] == c:
            k += 1
        if k == m:
            out.append(i - m + 1)
    return out


def border_matches(x: str, p: str) -> list[int]:
    """Falls back along plain borders."""
    ba = borders(p)
    return _by_border(x, p, ba, ba[-1] if ba else 0) if p else []


def kmp_matches(x: str, p: str) -> list[int]:
    """Falls back along restricted borders, which skip symbols known to differ."""
    ba = restricted_borders(p)
    return _by_border(x, p, ba, ba[-1] if ba else 0) if p else []


# --- strategies ------------------------------------------------------------


def _emit(found: Iterator[tuple[object, int, list[int]]]) -> Iterator[pa.RecordBatch]:
    rows: list[list] = [[], [], []]
    for t, p, at in found:
        rows[0] += [t] * len(at)
        rows[1] += [p] * len(at)
        rows[2] += at
        if len(rows[2]) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], schema=_SCHEMA)
            rows = [[], [], []]
    if rows[2]:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], schema=_SCHEMA)


def _each(matcher: Callable[[str, str], list[int]]):
    def one(texts: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        shared = texts.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def found():
                for batch in batches:
                    for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        for p, word in shared.value:
                            if word and word in x:
                                yield t, p, matcher(x, word)

            yield from _emit(found())

        return texts.mapInArrow(run, SCHEMA)

    return one


_machines: dict[str, object] = {}


def _machine(key: str, block: list[tuple[int, str]]):
    """The automaton of a block, or None without patterns; a worker keeps the last one."""
    import ahocorasick

    if key not in _machines:
        machine, words = ahocorasick.Automaton(), {}
        for p, word in block:
            if word:
                words.setdefault(word, []).append(p)
        for word, ids in words.items():
            machine.add_word(word, (len(word), ids))
        if words:
            machine.make_automaton()
        _machines.clear()
        _machines[key] = machine if words else None
    return _machines[key]


def _automaton(texts: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
    shared, key = texts.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(key, shared.value)
        if machine is None:
            deque(batches, 0)
            return

        def found():
            for batch in batches:
                for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    by: dict[int, list[int]] = {}
                    for end, (size, ids) in machine.iter(x):
                        for p in ids:
                            by.setdefault(p, []).append(end - size + 1)
                    for p, at in by.items():
                        yield t, p, at

        yield from _emit(found())

    return texts.mapInArrow(run, SCHEMA)


PART, PUSHED, TOGETHER = 64, 16, 1 << 18


def scan_positions(text: Column, pattern: Column) -> Column:
    """All positions of a pattern, by built-in expressions in one pass over the text.

    The text is split before each place where the pattern begins; sums of the lengths of the parts are the positions. Sums are
    kept for each PART of them, so that a text with many places needs no long sums.
    """
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(pattern, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    sizes = F.transform(F.split(text, quoted, -1), lambda x: F.length(x).cast("bigint"))

    def sums(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / PART).cast("int")), lambda b: total(F.slice(n, b * PART + 1, F.lit(PART))))
        upto = lambda k, i: total(F.slice(k, F.lit(1), F.floor(i / PART).cast("int"))) + total(F.slice(n, F.floor(i / PART).cast("int") * PART + 1, i % PART))
        inner = let(blocks, lambda k: F.transform(F.sequence(F.lit(1), F.size(n) - 1), lambda i: upto(k, i)))
        return F.when(F.size(n) > 1, inner).otherwise(F.array().cast("array<bigint>"))

    first = F.when(F.startswith(text, pattern), F.array(F.lit(0).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.when((F.length(pattern) > 0) & F.contains(text, pattern), F.concat(first, let(sizes, sums))).otherwise(F.array().cast("array<bigint>"))


def _scan(texts: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
    # One constant, however many patterns.
    wanted = F.from_json(F.lit(json.dumps([{"pattern_id": p, "pattern": word} for p, word in block])), "array<struct<pattern_id:bigint,pattern:string>>")
    if len(block) <= PUSHED:
        # The same as a filter, which reaches the source.
        texts = texts.where(reduce(Column.__or__, [F.contains("text", F.lit(word)) for _, word in block], F.lit(False)))
    met = texts.select("text_id", "text", F.inline(F.filter(wanted, lambda w: F.contains(F.col("text"), w["pattern"]))))
    return met.select("text_id", "pattern_id", F.explode(scan_positions(F.col("text"), F.col("pattern"))).alias("pos"))


def seed_filter(seeds: DataFrame, bits: int = FILTER) -> np.ndarray:
    """A Bloom filter (one hash) of the column ``seed``, as words of 64 bits. Its size is fixed, so it may be sent to all workers; the more seeds, the more places pass."""
    place = F.col("seed").bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = np.zeros(bits // 64, np.uint64)
    for batch in seeds.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow().to_batches():
        words[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return words


def _seeds(q: int, block: int, shared):
    """The positions of a text whose next ``q`` or ``4 * q`` symbols may begin a pattern: their hash and where their block lies."""
    schema = pa.schema([("text_id", pa.int64()), ("block_no", pa.int64()), ("pos", pa.int64()), ("seed", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = shared.value, [], 0
        low = np.uint64(len(words) * 64 - 1)

        def written() -> pa.RecordBatch:
            own, *rest = zip(*held)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(own), *(pa.array(np.concatenate(c)) for c in rest)], schema=schema)

        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                # Short texts side by side, long ones part by part.
                to, total = at, 0
                while to < len(texts) and (to == at or total + len(texts[to]) <= TOGETHER):
                    total += len(texts[to])
                    to += 1
                size_of = np.array([len(x) for x in texts[at:to]])
                whole = texts[at] if to == at + 1 else "".join(texts[at:to])
                begin = np.cumsum(size_of) - size_of
                for b in range(0, len(whole) - q + 1, TOGETHER):
                    near = seed_hashes(whole[b : b + TOGETHER + 4 * q - 1], q)
                    for h, m in ((near[:TOGETHER], q), (far_hashes(near, q), 4 * q)):
                        place = h & low
                        hit = np.flatnonzero((words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))
                        own = np.searchsorted(begin, hit + b, "right") - 1
                        pos = hit + b - begin[own]
                        inside = pos + m <= size_of[own]
                        hit, own, pos = hit[inside], own[inside], pos[inside]
                        if len(hit):
                            held.append((batch.column(0).take(pa.array(at + own)), pos // block, pos, h[hit].view(np.int64)))
                            size += len(hit)
                    if size >= ROWS:
                        yield written()
                        held, size = [], 0
                at = to
        if held:
            yield written()

    return run


def far_hashes(near: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the next ``4 * q`` symbols of each position, from those of ``q``."""
    n = max(0, len(near) - 3 * q)
    h = near[:n] ^ np.uint64(0x5851F42D4C957F2D)
    for k in (1, 2, 3):
        h = (h ^ near[k * q : k * q + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def seed_hashes(x: str, q: int) -> np.ndarray:
    s = symbols(x).astype(np.uint64)
    n = max(0, len(s) - q + 1)
    h = np.zeros(n, np.uint64)
    for j in range(q):
        h = (h ^ s[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def _text_blocks(block: int, halo: int):
    schema = pa.schema([("text_id", pa.int64()), ("block_no", pa.int64()), ("part", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for b in range(0, max(1, len(x)), block):
                    rows.append((t, b // block, x[b : b + block + halo]))
                    size += len(rows[-1][2])
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def by_seed(texts: DataFrame, patterns: DataFrame, q: int = SEED, block: int | None = None, unique: bool = False) -> DataFrame:
    """Long patterns meet texts on the hash of their first ``q`` symbols, those of at least ``4 * q`` on that of so many, and are then compared whole; the few short ones go by automaton.

    So patterns that share a common beginning do not all meet at its places. Only the places of a text that pass a filter of all seeds travel. A text is seen in blocks with a halo of the longest
    pattern, so the comparison never rescans a long text. ``unique``: the patterns are distinct and written already.
    """
    if not unique:
        # Written once, as the longest, the filter and the join each read them.
        patterns = cut(patterns.select("pattern_id", "pattern").where("pattern IS NOT NULL").distinct())
    longest = patterns.agg(F.max(F.length("pattern"))).first()[0] or 0
    # Small blocks, as symbols are counted from their begin, but a halo is a small part of its block.
    block = block or max(BLOCK, 8 * longest)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1).to_pylist()
            long_ = np.array([len(p) >= 4 * q for p in words])
            seed = np.zeros(len(words), np.uint64)
            seed[~long_] = seed_hashes("".join(p[:q] for p in words if len(p) < 4 * q), q)[::q]
            seed[long_] = far_hashes(seed_hashes("".join(p[: 4 * q] for p in words if len(p) >= 4 * q), q), q)[:: 4 * q]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seed.view(np.int64))], names=["pattern_id", "pattern", "seed"])

    keyed = patterns.where(F.length("pattern") >= q).mapInArrow(hashed, "pattern_id bigint, pattern string, seed bigint")
    shared = texts.sparkSession.sparkContext.broadcast(seed_filter(keyed.select("seed")))
    places = texts.mapInArrow(_seeds(q, block, shared), "text_id bigint, block_no bigint, pos bigint, seed bigint")
    near = places.join(keyed, "seed").select("text_id", "block_no", "pos", "pattern_id", "pattern")
    parts = texts.mapInArrow(_text_blocks(block, longest), "text_id bigint, block_no bigint, part string").select(F.col("text_id").alias("_t"), F.col("block_no").alias("_b"), "part")
    here = F.substring("part", (F.col("pos") - F.col("block_no") * block + 1).cast("int"), F.length("pattern"))
    same = F.col("text_id").eqNullSafe(F.col("_t")) & (F.col("block_no") == F.col("_b"))
    long_hits = near.join(parts, same).where(here == F.col("pattern")).select("text_id", "pattern_id", "pos")
    return long_hits.union(over_blocks(texts, patterns.where(F.length("pattern") < q), _automaton))


STRATEGIES = {"automaton": _automaton, "scan": _scan, "find": _each(find_all), "border": _each(border_matches), "kmp": _each(kmp_matches)}


def exact_matches(texts: DataFrame, patterns: DataFrame, strategy: str = "automaton") -> DataFrame:
    """All occurrences; see the module. ``seed`` needs each ``text_id`` once."""
    texts = texts.select("text_id", "text").where("text IS NOT NULL")
    if strategy == "seed":
        return by_seed(texts, patterns)
    return over_blocks(texts, patterns, STRATEGIES[strategy])
