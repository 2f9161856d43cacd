"""Indexes that are built once, written, and then searched for any number of patterns.

``build_index(texts)`` gives one row per text: the text with its suffix array,
common prefixes and, for both directions, the places of every symbol in the
transform (from which the count of a symbol before any rank is a binary search).
The row is what a search needs, so a search of a written index sorts nothing:
every block of patterns is one pass over the table. Arrays are little-endian
32-bit numbers.

``search_index`` finds exact matches by backward search (``fm``), by binary search
among the suffixes (``sa``) or by a walk in the suffix tree (``tree``).
``approx_index`` enumerates all alignments within ``d`` edits by backward search
over intervals of ranks. A path is given up where the rest of the pattern needs
more edits than are left; these bounds come from the reverse direction.

An index holds the arrays of the uses that it is built for; others are null.

Results for odd input are those of ``suffix`` and ``approx``: null texts take no
part; an empty text has its sentinel only; repeated rows of texts give their rows
as often; repeated patterns count once; further columns are ignored. A text lies
in one row, so it may have up to 2^28 symbols.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.functions.sequences import symbols
from weftline.operators import approx
from weftline.operators.pattern_blocks import over_blocks
from weftline.operators.suffix import Index, Tree, _batches, _bisect, _texts

ARRAYS = ("sa", "lcp", "places", "places_reversed", "syms", "less")
USES = {"fm": ("sa", "places", "syms", "less"), "sa": ("sa",), "tree": ("sa", "lcp"), "approx": ("sa", "places", "places_reversed", "syms", "less")}
SORTED = 1 << 18
SCHEMA = "text_id bigint, text string, " + ", ".join(f"{a} binary" for a in ARRAYS)
_SCHEMA = pa.schema([("text_id", pa.int64()), ("text", pa.string())] + [(a, pa.binary()) for a in ARRAYS])
_MATCH = pa.schema([(c, pa.int64()) for c in ("text_id", "pattern_id", "rank", "pos")])


def _places(x: Index) -> np.ndarray:
    """The ranks within each text, ordered by the symbol before their suffix; ranks before which nothing stands come first."""
    own = x.owner[x.sa]
    begin = x.start[own]
    code = np.where(x.sa > begin, x.dense[np.maximum(x.sa, 1) - 1], 0)
    order = np.argsort(own * (int(x.dense.max(initial=0)) + 1) + code, kind="stable")
    return order - begin


def _build(wanted: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, held in _batches(batch, SORTED):
                x = Index(held)
                made = {"sa": x.sa - x.start[x.owner[x.sa]]}
                if "lcp" in wanted:
                    made["lcp"] = x.lcp()
                if "places" in wanted:
                    made["places"] = _places(x)
                if "places_reversed" in wanted:
                    made["places_reversed"] = _places(Index([t[::-1] for t in held]))
                rows = []
                for i, (t, text) in enumerate(zip(ids, held)):
                    s = slice(x.start[i], x.start[i + 1])
                    row = {c: v[s].astype("<i4").tobytes() for c, v in made.items()}
                    if "syms" in wanted:
                        syms, n = np.unique(symbols(text), return_counts=True)
                        # Where the places of each symbol begin, and the end.
                        row |= {"syms": syms.astype("<i4").tobytes(), "less": np.concatenate(([1], 1 + np.cumsum(n))).astype("<i4").tobytes()}
                    rows.append((t, text, *(row.get(a) for a in ARRAYS)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    return run


def build_index(texts: DataFrame, *uses: str) -> DataFrame:
    """``text_id, text, sa, lcp, places, places_reversed, syms, less`` for the uses named (``USES``; all, if none is), to be written."""
    wanted = {a for use in uses or USES for a in USES[use]}
    return _texts(texts).mapInArrow(_build(wanted), SCHEMA)


class Held:
    """The index of one text."""

    def __init__(self, text: str, **arrays: bytes):
        self.text, self.raw = text, arrays
        self.sa = np.frombuffer(arrays["sa"], "<i4")
        self.n = len(self.sa)
        self.less = np.frombuffer(arrays.get("less", b""), "<i4").tolist()
        self.code = {chr(s): i for i, s in enumerate(np.frombuffer(arrays.get("syms", b""), "<i4").tolist())}
        self._numbers: dict[str, array] = {}

    def numbers(self, name: str) -> array:
        if name not in self._numbers:
            self._numbers[name] = array("i", self.raw[name])
        return self._numbers[name]

    def codes(self, p: str) -> list[int] | None:
        """The pattern in the text's alphabet, or None if the text lacks one of its symbols."""
        out = [self.code.get(c, -1) for c in p]
        return None if -1 in out else out

    def step(self, places: array, a: int, lo: int, hi: int) -> tuple[int, int]:
        """The ranks of suffixes that begin with a symbol followed by one of an interval of ranks."""
        beg, end = self.less[a], self.less[a + 1]
        lo = bisect_left(places, lo, beg, end)
        return lo, bisect_left(places, hi, lo, end)

    def interval(self, p: str) -> tuple[int, int]:
        """The ranks of the suffixes that begin with a pattern."""
        codes = self.codes(p)
        lo, hi, places = 0, self.n, self.numbers("places")
        for a in reversed(codes or []):
            lo, hi = self.step(places, a, lo, hi)
            if lo >= hi:
                break
        return (lo, hi) if codes is not None and lo < hi else (0, 0)

    def needed(self, codes: list[int]) -> list[int]:
        """For each prefix of a pattern the edits that it needs at least: how often its parts end to be found."""
        places, out, cuts = self.numbers("places_reversed"), [], 0
        lo, hi = 0, self.n
        for a in codes:
            lo, hi = self.step(places, a, lo, hi)
            if lo >= hi:
                lo, hi, cuts = 0, self.n, cuts + 1
            out.append(cuts)
        return out

    def alignments(self, p: str, d: int) -> Iterator[tuple[int, int, str, int]]:
        """Intervals of ranks, edits from the right, and cost of all alignments of a pattern."""
        codes = self.codes(p)
        if codes is None:
            return
        need, places, every = self.needed(codes), self.numbers("places"), range(len(self.code))
        todo = [(len(codes) - 1, 0, self.n, d, "")]
        while todo:
            i, lo, hi, left, edits = todo.pop()
            if i < 0:
                yield lo, hi, edits, d - left
                continue
            if need[i] > left:
                continue
            if left:
                todo.append((i - 1, lo, hi, left - 1, edits + "I"))
            for a in every if left else codes[i : i + 1]:
                beg, end = self.step(places, a, lo, hi)
                if beg < end:
                    todo.append((i - 1, beg, end, left - (a != codes[i]), edits + "M"))
                    if left and edits:
                        todo.append((i, beg, end, left - 1, edits + "D"))


def _held(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple[object, Held]]:
    for i in range(batch.num_rows):
        t, text, *arrays = (batch.column(c)[i].as_py() for c in range(2 + len(names)))
        if None in arrays:
            raise ValueError("the index was not built for this use")
        yield t, Held(text, **dict(zip(names, arrays)))


def _by_fm(x: Held, words: list[str]) -> list[tuple[int, int]]:
    return [x.interval(w) for w in words]


def _by_sa(x: Held, words: list[str]) -> list[tuple[int, int]]:
    return _bisect(x.text, x.sa, words)


def _by_tree(x: Held, words: list[str]) -> list[tuple[int, int]]:
    tree, out = Tree(x.text, x.sa, np.frombuffer(x.raw["lcp"], "<i4")), []
    for w in words:
        node, _, outcome = tree.locate(w)
        out.append(tuple(tree.nodes[node][:2]) if outcome in ("node match", "edge match") else (0, 0))
    return out


METHODS = {"fm": _by_fm, "sa": _by_sa, "tree": _by_tree}


def search_index(index: DataFrame, patterns: DataFrame, method: str = "fm") -> DataFrame:
    """``text_id, pattern_id, rank, pos`` of all matches; ``rank`` is the suffix order."""
    search, names = METHODS[method], USES[method]

    def one(index: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        shared = index.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, words = np.array([p for p, _ in shared.value], dtype=object), [w for _, w in shared.value]
            for batch in batches:
                for t, x in _held(batch, names):
                    found = np.array(search(x, words), np.int64).reshape(-1, 2)
                    size = found[:, 1] - found[:, 0]
                    which = np.repeat(np.arange(len(size)), size)
                    rank = found[which, 0] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
                    if len(rank):
                        yield pa.RecordBatch.from_arrays([pa.array([t] * len(rank), pa.int64()), pa.array(ids[which], pa.int64()), pa.array(rank), pa.array(x.sa[rank].astype(np.int64))], schema=_MATCH)

        return index.mapInArrow(run, "text_id bigint, pattern_id bigint, rank bigint, pos bigint")

    return over_blocks(index.select("text_id", "text", *names), patterns, one)


def approx_index(index: DataFrame, patterns: DataFrame, d: int) -> DataFrame:
    """``text_id, pattern_id, pos, edits, cigar, cigar_fwd, dist``: the rows of ``approx_matches``."""

    def one(index: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        shared = index.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for batch in batches:
                for t, x in _held(batch, USES["approx"]):
                    for k, p in shared.value:
                        for lo, hi, edits, cost in x.alignments(p, d):
                            told = (edits, approx.run_lengths(edits), approx.run_lengths(edits[::-1]), cost)
                            rows += [(t, k, pos, *told) for pos in x.sa[lo:hi].tolist()]
                            if len(rows) >= approx.ROWS:
                                yield approx.as_batch(rows)
                                rows = []
            if rows:
                yield approx.as_batch(rows)

        return index.mapInArrow(run, approx.SCHEMA)

    return over_blocks(index.select("text_id", "text", *USES["approx"]), patterns, one)
