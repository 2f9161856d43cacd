"""Problem 2: spans that stand verbatim in more than one record.

The paragraphs are all windows of ``LENGTH`` symbols of A, C, G, T, and the
band is one min-hash of a window's shorter words (its minimizer). Equal windows
always collide, so the recall is 1; and neighbouring windows mostly have the
same min-hash, so that one band stands for some 17 windows. A band carries the
packed symbols of its windows.

1. A worker makes the bands of its records. Of bands with the same symbols in
   several of its records all windows are shared: their runs are known at once,
   and only two of them, of different records, travel as bands. So a hot band costs two
   rows per worker, however many records hold it.
2. Bands travel once, in containers by range of the min-hash. Windows of min-hashes
   met in more than one record are compared in full: 64 symbols are 128 bits, so
   the verification is exact. Nothing is paired: a window is shared if the least
   and the greatest record that hold it differ.
3. What comes out is runs of shared windows, not positions; the runs of a record
   are joined.

Results for odd input: null and empty sequences have no spans; redelivered rows
(same ``ord``) are one record; rows with a null ``ord`` take no part; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.sequences import clean, clean_seq, symbols

LENGTH, WORD, BLOCK, SLOT_BANDS, FLUSH = 64, 32, 1 << 20, 1 << 16, 1 << 20
RUN = LENGTH - WORD + 1
_CODE = np.full(129, 255, np.uint8)
_CODE[[ord(c) for c in "ACGT"]] = [0, 1, 2, 3]


def _words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """2-bit codes of all words (other symbols as 0), and the positions of windows without other symbols."""
    code = _CODE[np.minimum(symbols(text), 128)]
    bad = np.concatenate(([0], np.cumsum(code == 255)))
    valid = np.flatnonzero(bad[LENGTH:] == bad[:-LENGTH]) if len(code) >= LENGTH else np.zeros(0, np.int64)
    part = np.concatenate((code & 3, np.zeros(2 * WORD + LENGTH, np.uint8))).astype(np.uint64)
    width = 1
    while width < WORD:
        part = (part[:-width] << np.uint64(2 * width)) | part[width:]
        width *= 2
    return part, valid


def _minima(word: np.ndarray) -> np.ndarray:
    """The least hash of the RUN words of each window."""
    h = word * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    least, width = h, 1
    while width * 2 <= RUN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = RUN - width
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def band_rows(text: str) -> tuple[np.ndarray, ...]:
    """Runs of windows with one min-hash: hash, first window, number of windows (at most RUN), and the symbols in three words."""
    word, valid = _words(text)
    if not len(valid):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    key = _minima(word)[valid]
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (valid[1:] != valid[:-1] + 1))))
    size = np.diff(np.append(first, len(valid)))
    # Long runs, in repeats, are cut so that three words hold their symbols.
    parts = -(-size // RUN)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    beg = valid[np.repeat(first, parts)] + nth * RUN
    size = np.minimum(np.repeat(size, parts) - nth * RUN, RUN)
    return np.repeat(key[first], parts).view(np.int64), beg, size, *(word[beg + i].view(np.int64) for i in (0, WORD, 2 * WORD))


Bands = tuple[np.ndarray, ...]  # min-hash, record, first window, number of windows, and the symbols in three words
_RUNS = "ord bigint, beg bigint, end bigint"
_PARTS = ("seed", "ord", "beg", "n", "w0", "w1", "w2")
_MADE = pa.schema([("slot", pa.int64())] + [(c, pa.binary()) for c in _PARTS])
_MADE_SQL = "slot bigint, " + ", ".join(f"{c} binary" for c in _PARTS)


def _packed(a: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).ravel()


def _masked(bands: Bands) -> Bands:
    """Without the symbols behind a band's last window, so that equal bands have equal words."""
    *rest, n, w0, w1, w2 = bands
    over = (3 * WORD - LENGTH + 1 - n).astype(np.uint64) * np.uint64(2)  # bits too many in the last word, at most all of them
    last = np.where(over < 64, (w2.view(np.uint64) >> (over & np.uint64(63))) << (over & np.uint64(63)), np.uint64(0)).view(np.int64)
    return *rest, n, w0, w1, last


def _split_by_copies(bands: Bands) -> tuple[Bands, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The bands that must travel, and the runs of windows already known to be shared: those of equal bands of several records."""
    seed, ord_, beg, n, *words = bands
    # Sorted by a hash of the band; were two to collide, bands would travel that need not.
    mixed = seed.view(np.uint64)
    for c in (n, *words):
        mixed = (mixed ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.lexsort((ord_, mixed))
    seed, ord_, beg, n, *words = (c[order] for c in bands)
    columns = (seed, n, *words)
    first = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0))))
    size = np.diff(np.append(first, len(seed)))
    last = first + size - 1
    several = ord_[first] != ord_[last]
    known = np.repeat(several, size)
    keep = np.zeros(len(seed), bool)
    keep[first] = True
    keep[last[several]] = True
    # A band of one record that repeats within it stays whole, as each place is a run of its own if the band is shared.
    keep |= ~known
    return tuple(c[keep] for c in (seed, ord_, beg, n, *words)), (ord_[known], beg[known], beg[known] + n[known] - 1 + LENGTH)


def _bands(slots: int):
    """Containers of bands by slot; those without min-hashes hold known runs, which only pass through a slot."""

    def written(held: list[Bands]) -> Iterator[pa.RecordBatch]:
        bands, known = _split_by_copies(_masked(tuple(map(np.concatenate, zip(*held)))))
        # Known runs are spread over the slots by their record.
        slot = known[0] % slots
        order = np.argsort(slot, kind="stable")
        cuts = np.searchsorted(slot[order], np.arange(slots + 1))
        rows = [(s, None, *(_packed(c[order[a:b]]) for c in known), None, None, None) for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]
        slot = ((bands[0].view(np.uint64) >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
        order = np.argsort(slot, kind="stable")
        cuts = np.searchsorted(slot[order], np.arange(slots + 1, dtype=np.uint64))
        bands = tuple(c[order] for c in bands)
        rows += [(s, *(_packed(c[a:b]) for c in bands)) for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MADE)], schema=_MADE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for o, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = clean(raw)
                for b in range(0, max(1, len(text) - LENGTH + 1), BLOCK):
                    key, beg, n, *words = band_rows(text[b : b + BLOCK + LENGTH - 1])
                    if len(key):
                        held.append((key, np.full(len(key), o, np.int64), beg + b, n, *words))
                        size += len(key)
                    if size > FLUSH:
                        yield from written(held)
                        held, size = [], 0
        if held:
            yield from written(held)

    return run


def _windows(n: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the bands the band, its place there, and its full content in two numbers."""
    w0, w1, w2 = (x.view(np.uint64) for x in words)
    row = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    left, right = (2 * i).astype(np.uint64), (64 - 2 * i).astype(np.uint64)
    some, whole = (i > 0) & (i < WORD), i == WORD
    right = np.where(some, right, np.uint64(1))  # no shift by 64

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(some, (a[row] << (left & np.uint64(63))) | (b[row] >> right), np.where(whole, b[row], a[row]))

    return row, i, join(w0, w1), join(w1, w2)


def _met(key: list[np.ndarray], ord_: np.ndarray) -> np.ndarray:
    """Which entries have a key that another record has as well."""
    order = np.lexsort(tuple(key))
    first = np.flatnonzero(np.concatenate(([True], np.any([c[order][1:] != c[order][:-1] for c in key], axis=0)))) if len(order) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(order)))
    out = np.zeros(len(ord_), bool)
    if len(first):
        own = ord_[order]
        out[order] = np.repeat(np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first), size)
    return out


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of shared windows of each slot."""
    schema = pa.schema([(c, pa.int64()) for c in ("ord", "beg", "end")])

    def found(held: list[Bands]) -> Iterator[pa.RecordBatch]:
        seed, ord_, beg, n, *words = map(np.concatenate, zip(*held))
        some = _met([seed], ord_)
        ord_, beg, n = ord_[some], beg[some], n[some]
        row, i, hi, lo = _windows(n, [w[some] for w in words])
        hit = _met([lo, hi], ord_[row])
        row, i = row[hit], i[hit]
        if len(row):
            new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (i[1:] != i[:-1] + 1))))
            last = np.append(new[1:], len(row)) - 1
            at = beg[row]
            yield pa.RecordBatch.from_arrays([pa.array(ord_[row[new]]), pa.array(at[new] + i[new]), pa.array(at[last] + i[last] + LENGTH)], schema=schema)

    slot, held = None, []
    for batch in batches:
        for now, *parts in zip(*(c.to_pylist() for c in batch.columns)):
            if parts[0] is None:
                yield pa.RecordBatch.from_arrays([pa.array(_unpacked(c)) for c in parts[1:4]], schema=schema)
                continue
            if now != slot and held:
                yield from found(held)
                held = []
            slot = now
            held.append(tuple(map(_unpacked, parts)))
    if held:
        yield from found(held)


def _joined(pos: DataFrame, *keys: str) -> DataFrame:
    """Ranges that overlap or touch, joined within the keys."""
    w = Window.partitionBy(*keys).orderBy("beg", "end")
    upto = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = pos.withColumn("new", F.when(F.col("beg") <= upto, 0).otherwise(1))
    run = new.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*keys, "run").agg(F.min("beg").alias("beg"), F.max("end").alias("end")).drop("run")


def shared_spans(records: DataFrame, slot_bands: int = SLOT_BANDS) -> DataFrame:
    """``ord, span_beg, span_end``: the maximal runs of positions that lie in a window which another record holds as well."""
    rows = records.select("ord", "seq").where("seq IS NOT NULL AND ord IS NOT NULL")
    # As many slots as hold about so many bands each; there is a band for some RUN / 2 symbols.
    size = rows.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]
    made = rows.mapInArrow(_bands(max(1, -(-2 * size // (RUN * slot_bands)))), _MADE_SQL)
    hits = made.repartition("slot").sortWithinPartitions("slot").mapInArrow(_shared, _RUNS)
    # First within ranges of a record, so that no task sorts all of a long one.
    part = _joined(hits.withColumn("range", F.floor(F.col("beg") / BLOCK)), "ord", "range").drop("range")
    return _joined(part, "ord").select("ord", F.col("beg").alias("span_beg"), F.col("end").alias("span_end"))


def shared_parts(records: DataFrame) -> DataFrame:
    """``ord, name, clean_len, shared_len, shared_part, spans`` of every record; nothing shared is 0 and an empty list."""
    every = records.select("ord", "name", F.length(clean_seq(F.col("seq"))).cast("bigint").alias("clean_len")).where("ord IS NOT NULL").distinct()
    size = F.col("span_end") - F.col("span_beg")
    found = shared_spans(records).groupBy("ord").agg(F.sum(size).alias("shared_len"), F.array_sort(F.collect_list(F.struct("span_beg", "span_end"))).alias("spans"))
    part = F.when(F.col("clean_len") > 0, F.coalesce("shared_len", F.lit(0)) / F.col("clean_len"))
    nothing = F.array().cast("array<struct<span_beg:bigint,span_end:bigint>>")
    return every.join(found, "ord", "left").select("ord", "name", "clean_len", F.coalesce("shared_len", F.lit(0)).alias("shared_len"), part.alias("shared_part"), F.coalesce("spans", nothing).alias("spans"))
