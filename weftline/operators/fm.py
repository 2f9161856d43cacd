"""Burrows-Wheeler transform, its tables and the FM-index search.

The sentinel has code 0 and no symbol (null). ``o_table`` is sparse: one row
per rank with the count of its own symbol up to and including that rank; the
count of a symbol before any rank is that of its last row before it.
Results for odd input are those of ``suffix``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.sequences import symbols
from weftline.operators.pattern_blocks import over_blocks
from weftline.operators.suffix import _texts, search_rows, suffix_index


def bwt(texts: DataFrame) -> DataFrame:
    """``text_id, rank, code, ch``: the symbol before each suffix."""
    return suffix_index(texts, "rank", "code", "ch")


def bwt_of_reverse(texts: DataFrame) -> DataFrame:
    """The same of the reversed texts, the second direction of an index for approximate search."""
    return bwt(texts.select("text_id", F.reverse("text").alias("text")))


def c_table(texts: DataFrame) -> DataFrame:
    """``text_id, code, c``: how many symbols of a text, the sentinel included, are smaller."""
    schema = pa.schema([("text_id", pa.int64()), ("code", pa.int32()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for text in batch.column(1).to_pylist():
                n = np.unique(symbols(text), return_counts=True)[1]
                parts.append(np.concatenate(([0], 1 + np.cumsum(n) - n)))
            size = [len(c) for c in parts]
            if size:
                owner = np.repeat(np.arange(len(size)), size)
                code = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(code.astype(np.int32)), pa.array(np.concatenate(parts))], schema=schema)

    return _texts(texts).mapInArrow(run, "text_id bigint, code int, c bigint").distinct()


def o_table(texts: DataFrame) -> DataFrame:
    """``text_id, rank, code, occ`` (inclusive), sparse."""
    return suffix_index(texts, "rank", "code", "occ")


def lf_mapping(texts: DataFrame) -> DataFrame:
    """``text_id, rank, lf``: the rank of the suffix that is one symbol longer; the whole text's goes to the sentinel."""
    return suffix_index(texts, "rank", "lf")


def invert(code: np.ndarray, ch: np.ndarray) -> str:
    """The text of a transform, by pointer doubling along LF: round k fixes 2**k positions at once."""
    n = len(code)
    order = np.argsort(code, kind="stable")
    lf = np.empty(n, np.int64)
    lf[order] = np.arange(n)
    # Rank of the suffix k symbols from the end: 0, lf[0], lf[lf[0]] ...
    path, jump = np.zeros(1, np.int64), lf
    while len(path) < n:
        path = np.concatenate((path, jump[path]))[:n]
        jump = jump[jump]
    return "".join(ch[path[: n - 1]][::-1])


def inverse_bwt(rows: DataFrame) -> DataFrame:
    """``text_id, text`` from ``text_id, rank, code, ch``. A text is rebuilt in one task."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        text = invert(table.column("code").to_numpy(), np.array(table.column("ch").to_pylist(), dtype=object))
        return pa.table([table.column("text_id")[:1], pa.array([text])], names=["text_id", "text"])

    return rows.select("text_id", "rank", "code", "ch").groupBy("text_id").applyInArrow(run, "text_id bigint, text string")


def _backward(text: str, sa: np.ndarray, words: list[str]) -> list[tuple[int, int]]:
    """Rank intervals by backward search; the places of each symbol in the transform are its O table."""
    code = symbols(text).astype(np.int64) + 1
    last = np.where(sa > 0, code[sa - 1] if len(code) else 0, 0)
    order = np.argsort(last, kind="stable")
    values, begin = np.unique(last[order], return_index=True)
    places = dict(zip(values.tolist(), np.split(order, begin[1:])))
    less = dict(zip(values.tolist(), begin.tolist()))
    out = []
    for w in words:
        lo, hi = 0, len(sa)
        for c in reversed(w):
            at = places.get(ord(c) + 1)
            if at is None:
                lo = hi = 0
                break
            lo, hi = (less[ord(c) + 1] + int(i) for i in np.searchsorted(at, (lo, hi)))
            if lo >= hi:
                lo = hi = 0
                break
        out.append((lo, hi))
    return out


def fm_search(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``text_id, pattern_id, rank, pos`` of all matches, by backward search."""
    return over_blocks(_texts(texts), patterns, search_rows(_backward))


def fm_index(texts: DataFrame) -> DataFrame:
    """All tables of the index in one: ``text_id, rank, pos, code, ch, occ, c``, to be written once and searched often."""
    return suffix_index(texts, "rank", "pos", "code", "ch", "occ", "c")
