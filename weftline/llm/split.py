"""Problem 1: cutting oversized sequences into overlapping pieces at gaps.

A sequence is handled as byte ranges (blocks), one row each, which are spread over
all workers; a row carries the clean symbols of its range and a halo of those
that follow, as many as a piece may have. For each range a worker finds the runs
of symbols other than A, C, G, T and the clean length; these boundary tables are
small. Runs that touch at the edges of ranges are stitched and clean lengths are
summed to offsets, record by record (``_stitched``): gaps come from there, and
pieces are planned there on the boundaries alone. Every piece is then emitted by
offset from the range in which it begins. No step after the ranges are cut holds
a whole sequence.

Results for odd input: null sequences take no part; empty ones have no piece;
redelivered rows (same ``ord``) count once; rows with a null ``ord`` are records
of their own, equal ones once; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.sequences import clean, symbols

LIMIT, OVERLAP, MIN_GAP, BLOCK = 2000, 100, 10, 1 << 16
BATCH = 1 << 24
_ACGT = np.zeros(128, bool)
_ACGT[[ord(c) for c in "ACGT"]] = True


def foreign_runs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of symbols other than A, C, G, T."""
    s = symbols(text)
    other = ~(_ACGT[np.minimum(s, 127)] & (s < 128))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], other.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


_RANGES = pa.schema([("ord", pa.int64()), ("own", pa.int64()), ("block_no", pa.int64()), ("clean_len", pa.int64()), ("text", pa.string())])


def _cut(halo: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i, (o, own) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                raw = memoryview(batch.column(2)[i].as_buffer())
                n = len(raw)

                def part(beg: int, end: int) -> tuple[str, int]:
                    """Clean symbols of a byte range that ends at the next whole symbol, and that end."""
                    while end < n and raw[end] & 0xC0 == 0x80:
                        end += 1
                    return clean(str(raw[beg:end], "utf-8")), min(end, n)

                beg, block_no = 0, 0
                while beg < n or block_no == 0:
                    text, end = part(beg, min(n, beg + block))
                    after, at = "", end
                    while len(after) < halo and at < n:
                        more, at = part(at, min(n, at + halo))
                        after += more
                    rows.append((o, own, block_no, len(text), text + after[:halo]))
                    size += len(rows[-1][4])
                    beg, block_no = end, block_no + 1
                    if size > BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RANGES)], schema=_RANGES)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RANGES)], schema=_RANGES)

    return run


def ranges(records: DataFrame, halo: int, block: int = BLOCK) -> DataFrame:
    """``ord, own, block_no, clean_len, text``: the byte ranges of all records, spread over the workers, each once; ``own`` tells records without ``ord`` apart."""
    own = F.when(F.col("ord").isNull(), F.xxhash64("seq")).otherwise(F.lit(0).cast("bigint"))
    cut = records.where("seq IS NOT NULL").select("ord", own.alias("own"), "seq").mapInArrow(_cut(halo, block), "ord bigint, own bigint, block_no bigint, clean_len bigint, text string")
    return cut.repartition("ord", "own", "block_no").distinct()


_BOUNDS = pa.schema([("ord", pa.int64()), ("own", pa.int64()), ("block_no", pa.int64()), ("clean_len", pa.int64()), ("run_beg", pa.list_(pa.int64())), ("run_end", pa.list_(pa.int64()))])


def _boundaries(min_gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[list[int], list[int]]] = []
            for n, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                beg, end = foreign_runs(text[:n])
                keep = (end - beg >= min_gap) | (beg == 0) | (end == n)
                found.append((beg[keep].tolist(), end[keep].tolist()))
            runs = [pa.array(c, pa.list_(pa.int64())) for c in zip(*found)] if found else [pa.array([], pa.list_(pa.int64()))] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *runs], schema=_BOUNDS)

    return run


def boundary_table(ranges_: DataFrame, min_gap: int = MIN_GAP) -> DataFrame:
    """The runs and the clean length of every range, in order and together by record."""
    table = ranges_.mapInArrow(_boundaries(min_gap), "ord bigint, own bigint, block_no bigint, clean_len bigint, run_beg array<bigint>, run_end array<bigint>")
    return table.repartition("ord", "own").sortWithinPartitions("ord", "own", "block_no")


def _stitched(batches: Iterator[pa.RecordBatch], min_gap: int) -> Iterator[tuple[int | None, int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of every record ``ord, own``, the offsets of its ranges, the begins and ends of its gaps, and its clean length."""

    def whole(key: tuple, lengths: list[int], begs: list[list[int]], ends: list[list[int]]):
        starts = np.cumsum([0, *lengths])
        beg, end = (np.concatenate([np.array(r, np.int64) + s for r, s in zip(runs, starts)]) for runs in (begs, ends))
        if len(beg):
            first = np.concatenate(([True], beg[1:] != end[:-1]))
            beg, end = beg[first], end[np.concatenate((first[1:], [True]))]
            keep = end - beg >= min_gap
            beg, end = beg[keep], end[keep]
        return *key, starts[:-1], beg, end, int(starts[-1])

    key, held = None, ([], [], [])
    for batch in batches:
        for o, own, _, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (o, own) != key:
                if key is not None:
                    yield whole(key, *held)
                key, held = (o, own), ([], [], [])
            for column, value in zip(held, row):
                column.append(value)
    if key is not None:
        yield whole(key, *held)


ROWS = 1 << 16


def _gap_rows(limit: int, min_gap: int):
    schema = pa.schema([(c, pa.int64()) for c in ("ord", "gap_beg", "gap_end")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for o, _, _, beg, end, total in _stitched(batches, min_gap):
            if total > limit:
                rows += [(o, b, e) for b, e in zip(beg.tolist(), end.tolist())] or [(o, -1, -1)]
            if len(rows) > ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    return run


def gaps(records: DataFrame, limit: int = LIMIT, min_gap: int = MIN_GAP, block: int = BLOCK) -> DataFrame:
    """``ord, gap_beg, gap_end`` of every gap of the records longer than ``limit``; -1, -1 for one without a gap."""
    return boundary_table(ranges(records, 0, block), min_gap).mapInArrow(_gap_rows(limit, min_gap), "ord bigint, gap_beg bigint, gap_end bigint")


def cut_points(total: int, beg: np.ndarray, end: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, bool]]:
    """Pieces (begin, end, ends at a gap). A piece ends at the last place in reach that lies in or at the edge of a gap, else at the limit."""
    pieces, at = [], 0
    while at + limit < total:
        to = at + limit
        g = int(np.searchsorted(beg, to, "right")) - 1
        stop = min(int(end[g]), to) if g >= 0 else -1
        at_gap = stop > at + overlap
        stop = stop if at_gap else to
        pieces.append((at, stop, at_gap))
        at = stop - overlap
    return [*pieces, (at, total, False)] if total else []


def _plan(limit: int, overlap: int, min_gap: int):
    schema = pa.schema([(c, pa.int64()) for c in ("ord", "own", "block_no", "piece_no", "piece_beg", "piece_end", "at")] + [("at_gap", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for o, own, starts, beg, end, total in _stitched(batches, min_gap):
            found = cut_points(total, beg, end, limit, overlap)
            # The last range that begins at or before the piece; ranges without symbols share their begin with the next.
            inside = np.searchsorted(starts, [p[0] for p in found], "right") - 1
            rows += [(o, own, k, i, b, e, b - int(starts[k]), g) for i, (k, (b, e, g)) in enumerate(zip(inside.tolist(), found))]
            if len(rows) > ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def pieces(records: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, min_gap: int = MIN_GAP, block: int = BLOCK) -> DataFrame:
    """``ord, piece_no, piece_beg, piece_end, at_gap, piece``: pieces of at most ``limit`` symbols that cover each record.

    Each piece begins exactly ``overlap`` symbols before the end of its predecessor. A record within the limit is one piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")
    all_ranges = ranges(records, limit, block)
    schema = "ord bigint, own bigint, block_no bigint, piece_no bigint, piece_beg bigint, piece_end bigint, at bigint, at_gap boolean"
    plan = boundary_table(all_ranges, min_gap).mapInArrow(_plan(limit, overlap, min_gap), schema)
    texts = all_ranges.select(F.col("ord").alias("_o"), F.col("own").alias("_w"), F.col("block_no").alias("_b"), "text")
    # No comparison here asks for a filter of nulls, so that both sides read the ranges from one shuffle.
    same = F.col("ord").eqNullSafe(F.col("_o")) & F.col("own").eqNullSafe(F.col("_w")) & F.col("block_no").eqNullSafe(F.col("_b"))
    size = F.col("piece_end") - F.col("piece_beg")
    return plan.join(texts, same).select("ord", "piece_no", "piece_beg", "piece_end", "at_gap", F.substring("text", (F.col("at") + 1).cast("int"), size.cast("int")).alias("piece"))
