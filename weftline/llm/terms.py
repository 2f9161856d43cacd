"""Problem 5: occurrences and records of every term, by burst tries.

A term is a window of ``k`` symbols over a small alphabet, so it has a code of
2 bits a symbol and the sorted codes of a worker are the leaves of its trie in
order. A worker counts occurrences and records of each term of its rows, and
bursts every node of the trie that holds more than ``LOAD`` terms; each leaf is
written as one compact container (byte planes of its suffixes and counters).

Terms are routed by prefixes that follow the load: the loads of the containers
are summed for all prefixes above them, and a prefix under which all workers
together hold more than ``ROUTE_LOAD`` terms (or 1 of ``ROUTES`` of all) is burst
into its four children, so a hot prefix becomes many routes. Containers that lie
across several routes are cut; matching subtrees are merged as they arrive, and a
task holds the terms of one route, never the containers of all workers. A hot
term costs one entry per worker, not one per occurrence.

Results for odd input: null sequences count neither as records nor for terms;
empty and short ones count as records without terms; redelivered rows (same
``ord``) count once; windows with other symbols hold no term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.sequences import DROP
from weftline.plans.lineage import cut

K, COMMON, LOAD, ROUTE_LOAD, ROUTES, FLUSH = 10, 40, 512, 1 << 18, 1 << 14, 1 << 22
_CODE = np.full(128, 4, np.uint8)
_CODE[[ord(c) for c in "ACGTacgt"]] = [0, 1, 2, 3] * 2


def window_codes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all valid windows, and the number of the text each comes from."""
    texts = [t.translate(DROP) for t in texts]
    joined = "\n".join(texts)
    raw = np.frombuffer(joined.encode("latin-1", "replace") if not joined.isascii() else joined.encode(), np.uint8)
    if len(raw) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.where(raw < 128, _CODE[np.minimum(raw, 127)], 4)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: len(raw)]
    bad = np.concatenate(([0], np.cumsum(code == 4)))
    n = len(raw) - k + 1
    valid = np.flatnonzero(bad[k:] == bad[:n])
    # Windows by doubling: each step joins two halves.
    part, width, whole, used = code.astype(np.int64) & 3, 1, np.zeros(n, np.int64), 0
    while True:
        if k & width:
            whole = (whole << (2 * width)) | part[used : used + n]
            used += width
        if width * 2 > k:
            break
        part = (part[:-width] << (2 * width)) | part[width:]
        width *= 2
    return whole[valid], owner[valid]


def _packed(a: np.ndarray) -> bytes:
    """Compressed byte planes, in which the upper bytes of small numbers vanish."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).ravel()


def _merge(code: np.ndarray, occ: np.ndarray, rec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return code[first], np.add.reduceat(occ[order], first), np.add.reduceat(rec[order], first)


def leaves(code: np.ndarray, k: int, load: int = LOAD) -> list[tuple[int, int, int]]:
    """Begin, end and depth of the leaves of a trie of sorted codes: a node with more than ``load`` terms is burst into its children."""
    out, todo = [], [(0, len(code), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo <= load or depth == k:
            out.append((lo, hi, depth))
            continue
        step = 2 * (k - depth - 1)
        child = (int(code[lo]) >> (step + 2)) << 2
        ends = [lo, *(lo + np.searchsorted(code[lo:hi], np.arange(child + 1, child + 4) << step)).tolist(), hi]
        todo += [(a, b, depth + 1) for a, b in zip(ends, ends[1:]) if b > a]
    return out


_PARTIAL = pa.schema([("first", pa.int64()), ("last", pa.int64()), ("depth", pa.int32()), ("n", pa.int64()), ("codes", pa.binary()), ("occ", pa.binary()), ("rec", pa.binary())])
_PARTIAL_SQL = "first bigint, last bigint, depth int, n bigint, codes binary, occ binary, rec binary"


def _count(k: int, load: int = LOAD):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def burst() -> pa.RecordBatch:
            code, occ, rec = _merge(*map(np.concatenate, zip(*held)))
            at = leaves(code, k, load)
            a, b, depth = zip(*at)
            first, last = code[list(a)], code[np.array(b) - 1]
            parts = [pa.array([_packed(x[i:j]) for i, j in zip(a, b)], pa.binary()) for x in (code, occ, rec)]
            return pa.RecordBatch.from_arrays([pa.array(first), pa.array(last), pa.array(depth, pa.int32()), pa.array(np.subtract(b, a)), *parts], schema=_PARTIAL)

        for batch in batches:
            code, owner = window_codes(batch.column(0).to_pylist(), k)
            if not len(code):
                continue
            # Sorted by term and record: a change of either begins a new record of a term.
            if 2 * k + int(owner[-1]).bit_length() < 63:
                both = np.sort((code << np.int64(int(owner[-1]).bit_length())) | owner)
                code = both >> np.int64(int(owner[-1]).bit_length())
                fresh = np.concatenate(([True], both[1:] != both[:-1]))
            else:
                order = np.lexsort((owner, code))
                code, owner = code[order], owner[order]
                fresh = np.concatenate(([True], (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])))
            first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            held.append((code[first], np.diff(np.append(first, len(code))), np.add.reduceat(fresh.astype(np.int64), first)))
            if sum(len(x[0]) for x in held) > FLUSH:
                held = [_merge(*map(np.concatenate, zip(*held)))]
                if len(held[0][0]) > FLUSH // 2:
                    yield burst()
                    held = []
        if held:
            yield burst()

    return run


_ROUTED = pa.schema([("route", pa.int64()), ("codes", pa.binary()), ("occ", pa.binary()), ("rec", pa.binary())])


def routes(crowded: list[tuple[int, int]], k: int) -> np.ndarray:
    """The first code of every route: the children of the crowded prefixes ``(depth, prefix)``."""
    starts = {0}
    for depth, prefix in crowded:
        if depth < k:
            starts.update((prefix * 4 + c) << (2 * (k - depth - 1)) for c in range(4))
    return np.array(sorted(starts), np.int64)


def _routed(starts: np.ndarray):
    """Containers with their route; those across several routes are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = (np.searchsorted(starts, batch.column(i).to_numpy(), "right") - 1 for i in (0, 1))
            one = pa.array(lo == hi)
            yield pa.RecordBatch.from_arrays([pa.array(lo).filter(one), *(batch.column(i).filter(one) for i in (4, 5, 6))], schema=_ROUTED)
            rows: list[tuple] = []
            for i in np.flatnonzero(lo != hi).tolist():
                parts = [_unpacked(batch.column(c)[i].as_py()) for c in (4, 5, 6)]
                route = np.searchsorted(starts, parts[0], "right") - 1
                at = [*np.flatnonzero(np.concatenate(([True], route[1:] != route[:-1]))).tolist(), len(route)]
                rows += [(int(route[a]), *(_packed(x[a:b]) for x in parts)) for a, b in zip(at, at[1:])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROUTED)], schema=_ROUTED)

    return run


def _merged(k: int):
    """The terms of each route; containers are merged whenever FLUSH of their terms are held."""
    letters = np.frombuffer(b"ACGT", np.uint8)
    schema = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])

    def written(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        whole = _merge(*map(np.concatenate, zip(*held)))
        for at in range(0, len(whole[0]), 1 << 16):
            code, occ, rec = (x[at : at + (1 << 16)] for x in whole)
            text = letters[(code[:, None] >> np.arange(2 * k - 2, -1, -2)) & 3]
            terms = pa.Array.from_buffers(pa.string(), len(code), [None, pa.py_buffer(np.arange(0, k * len(code) + 1, k, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(text))])
            yield pa.RecordBatch.from_arrays([terms, pa.array(occ), pa.array(rec)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route, held, size = None, [], 0
        for batch in batches:
            for now, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                if now != route and held:
                    yield from written(held)
                    held, size = [], 0
                route = now
                held.append(tuple(map(_unpacked, parts)))
                size += len(held[-1][0])
                if size > FLUSH:
                    held = [_merge(*map(np.concatenate, zip(*held)))]
                    size = 0  # what is merged no longer grows with the workers
        if held:
            yield from written(held)

    return run


def records_of(reads: DataFrame) -> DataFrame:
    """One row per record that has a sequence."""
    return reads.select("ord", "seq").where("seq IS NOT NULL").distinct()


def crowded_prefixes(containers: DataFrame, k: int, route_load: int = ROUTE_LOAD) -> list[tuple[int, int]]:
    """``depth, prefix`` of the prefixes to be burst, at most ``ROUTES`` of each depth, from the loads of the containers."""
    total = containers.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(route_load, total // ROUTES)
    above = F.transform(F.sequence(F.lit(0), "depth"), lambda d: F.struct(d.alias("d"), F.col("first").alias("first")))
    nodes = containers.select("n", F.explode(above).alias("a")).select("n", "a.d", F.call_function("shiftright", "a.first", 2 * (F.lit(k) - F.col("a.d"))).alias("prefix"))
    loads = nodes.groupBy("d", "prefix").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
    return [(r["d"], r["prefix"]) for r in loads.select("d", "prefix").collect()]


def term_frequencies(reads: DataFrame, k: int = K, load: int = LOAD, route_load: int = ROUTE_LOAD) -> DataFrame:
    """``term, occurrences, records`` of every window of ``k`` (at most 31) symbols of A, C, G, T."""
    if not 1 <= k <= 31:
        raise ValueError("k must be from 1 to 31")
    containers = cut(records_of(reads).select("seq").mapInArrow(_count(k, load), _PARTIAL_SQL))
    starts = routes(crowded_prefixes(containers.select("first", "depth", "n"), k, route_load), k)
    routed = containers.mapInArrow(_routed(starts), "route bigint, codes binary, occ binary, rec binary")
    return routed.repartition("route").sortWithinPartitions("route").mapInArrow(_merged(k), "term string, occurrences bigint, records bigint")


def marked_terms(reads: DataFrame, k: int = K, common: int = COMMON) -> DataFrame:
    """``term, occurrences, records, mark``: ``rare`` in one record, else ``common`` in at least 1 of ``common`` records, else null."""
    n = reads.where("seq IS NOT NULL").select("ord", F.xxhash64("seq").alias("h1"), F.xxhash64(F.lit(1), "seq").alias("h2")).distinct().agg(F.count("*").alias("n"))
    mark = F.when(F.col("records") == 1, "rare").when(F.col("records") * common >= n.scalar(), "common")
    return term_frequencies(reads, k).withColumn("mark", mark)
