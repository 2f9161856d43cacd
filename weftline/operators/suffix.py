"""Suffix structures: suffix array, LCP, symbol types and buckets, suffix tree and searches.

``texts(text_id, text)``. Every text ends in a sentinel that is smaller than
all symbols: the empty suffix at ``pos = length(text)``, which always has rank
0. Positions are 0-based code points.

One row per suffix with all that derives from its neighbours (``suffix_index``)
is made text by text in Arrow batches: all suffixes of a batch are sorted
together by prefix doubling, of which each round sorts only what is still tied.
Texts longer than ``LOCAL`` symbols are sorted by the same doubling as
DataFrame joins instead (strategy ``doubling``), in which no task sorts a text.

Results for odd input: null texts take no part; an empty text has its sentinel
only; an empty pattern matches all ``n + 1`` suffixes of a text; a pattern with
a symbol that the text does not have matches none; repeated rows give their
rows as often; further columns are ignored. Texts must not hold NUL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.sequences import symbols
from weftline.operators.pattern_blocks import over_blocks
from weftline.plans.lineage import cut, discard, scratch
from weftline.plans.ordinal import with_first_ordinal

BATCH, LOCAL, STEP, ROWS = 1 << 20, 1 << 25, 16, 1 << 17


class Index:
    """Suffix arrays of several texts, one after the other."""

    def __init__(self, texts: list[str]):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.start = np.concatenate(([0], np.cumsum(sizes)))
        self.code = np.zeros(int(self.start[-1]), np.int64)  # 0 is the sentinel
        body = np.ones(len(self.code), bool)
        body[self.start[1:] - 1] = False
        self.code[body] = symbols("".join(texts)).astype(np.int64) + 1
        self.owner = np.repeat(np.arange(len(texts)), sizes)
        self._sort()

    def _sort(self) -> None:
        n = len(self.code)
        key = (self.owner << 32) | self.code
        sa = np.argsort(key, kind="stable")
        key = key[sa]
        first = np.concatenate(([True], key[1:] != key[:-1])) if n else np.zeros(0, bool)
        #: dense code of each symbol within its text
        fresh = np.cumsum(first)
        dense = np.empty(n, np.int64)
        dense[sa] = fresh - fresh[self.start[:-1]][self.owner[sa]]
        self.dense = dense
        rank = np.empty(n, np.int64)
        rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        tied = self._tied(first)
        k = 1
        while len(tied):
            sub = sa[tied]
            key = rank[sub] * (n + 1) + rank[np.minimum(sub + k, n - 1)]
            order = np.argsort(key, kind="stable")
            sub, key = sub[order], key[order]
            sa[tied] = sub
            new = np.concatenate(([True], key[1:] != key[:-1]))
            rank[sub] = np.maximum.accumulate(np.where(new, tied, 0))
            tied = tied[self._tied(new)]
            k *= 2
        self.sa, self.rank = sa, rank

    @staticmethod
    def _tied(first: np.ndarray) -> np.ndarray:
        last = np.append(first[1:], True)
        return np.flatnonzero(~(first & last))

    def lcp(self) -> np.ndarray:
        """Common prefix with the suffix before, within a text; 0 for the first."""
        out = np.zeros(len(self.sa), np.int64)
        live = np.ones(len(self.sa), bool)
        live[self.start[:-1]] = False
        padded = np.concatenate((self.code, np.zeros(STEP, np.int64)))
        for part in np.array_split(np.flatnonzero(live), max(1, len(live) >> 16)):
            self._lcp(part, padded, out)
        return out

    def _lcp(self, live: np.ndarray, padded: np.ndarray, out: np.ndarray) -> None:
        """The same for some ranks, as many symbols at a time as STEP."""
        a, b = self.sa[live - 1], self.sa[live]
        ahead = np.arange(STEP)
        while len(live):
            same = padded[a[:, None] + ahead] == padded[b[:, None] + ahead]
            # Both at their sentinel cannot be: the suffixes have different lengths.
            size = np.where(same.all(axis=1), STEP, same.argmin(axis=1))
            out[live] += size
            more = size == STEP
            live, a, b = live[more], a[more] + STEP, b[more] + STEP

    def types(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether the suffix at each position is smaller than the next one (the sentinel is), and whether it is the first such after a larger one."""
        n = len(self.code)
        small = np.zeros(n, bool)
        if n:
            small[:-1] = self.rank[:-1] < self.rank[1:]
            small[self.start[1:] - 1] = True
        before = np.concatenate(([True], small[:-1])) if n else small
        lms = small & ~before
        lms[self.start[:-1]] = False
        return small, lms


def _batches(batch: pa.RecordBatch, symbols_: int = BATCH) -> Iterator[tuple[list, list[str]]]:
    """Texts of a batch in parts of bounded size."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size < symbols_):
            size += len(texts[to])
            to += 1
        yield ids[at:to], texts[at:to]
        at = to


COLUMNS = {"rank": "bigint", "pos": "bigint", "lcp": "bigint", "code": "int", "ch": "string", "sym_code": "int", "s_type": "boolean", "lms": "boolean", "lf": "bigint", "c": "bigint", "occ": "bigint"}


class Rows:
    """The columns of an index in order of rank, each made when it is asked for."""

    def __init__(self, x: Index):
        self.x, self.own = x, x.owner[x.sa]
        self.begin = x.start[self.own]
        self.at = x.sa - self.begin
        self.has = self.at > 0  # a symbol stands before the suffix
        self.last = np.where(self.has, x.sa - 1, x.sa)

    def rank(self) -> pa.Array:
        return pa.array(np.arange(len(self.at)) - self.begin)

    def pos(self) -> pa.Array:
        return pa.array(self.at)

    def lcp(self) -> pa.Array:
        return pa.array(self.x.lcp())

    def _code(self) -> np.ndarray:
        return np.where(self.has, self.x.dense[self.last], 0)

    def code(self) -> pa.Array:
        return pa.array(self._code().astype(np.int32))

    def ch(self) -> pa.Array:
        chars = np.where(self.has, self.x.code[self.last] - 1, 0).astype(np.uint32)
        one = chars.view("U1") if len(chars) else np.zeros(0, "U1")
        return pa.array(one.astype(object), pa.string(), mask=~self.has)

    def _sym_code(self) -> np.ndarray:
        return np.where(self.at == self.x.start[self.own + 1] - 1 - self.begin, 0, self.x.dense[self.x.sa])

    def sym_code(self) -> pa.Array:
        return pa.array(self._sym_code().astype(np.int32))

    def s_type(self) -> pa.Array:
        return pa.array(self.x.types()[0][self.x.sa])

    def lms(self) -> pa.Array:
        return pa.array(self.x.types()[1][self.x.sa])

    def _lf(self) -> np.ndarray:
        """The rank of the suffix that is one symbol longer; the whole text's is the sentinel's."""
        return np.where(self.has, self.x.rank[self.last] - self.begin, 0)

    def lf(self) -> pa.Array:
        return pa.array(self._lf())

    def _c(self) -> np.ndarray:
        """How many symbols of the text are smaller: where the suffixes that begin with this symbol start."""
        wide = int(self.x.dense.max(initial=0)) + 1
        return np.searchsorted(self.own * wide + self._sym_code(), self.own * wide + self._code()) - self.begin

    def c(self) -> pa.Array:
        return pa.array(self._c())

    def occ(self) -> pa.Array:
        """How often the symbol stands in the transform up to this rank."""
        return pa.array(self._lf() - self._c() + 1)


def _index(names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _batches(batch):
                rows = Rows(Index(texts))
                columns = [pa.array(np.array(ids, dtype=object)[rows.own], pa.int64()), *(getattr(rows, n)() for n in names)]
                whole = pa.RecordBatch.from_arrays(columns, names=["text_id", *names])
                for at in range(0, whole.num_rows, 1 << 17):
                    yield whole.slice(at, 1 << 17)

    return run


def _texts(texts: DataFrame) -> DataFrame:
    return texts.select("text_id", "text").where("text IS NOT NULL")


def suffix_index(texts: DataFrame, *names: str) -> DataFrame:
    """Per suffix, by ``text_id, rank``, the columns asked for (all, if none is named); what is not asked for is not computed.

    ``pos``; ``lcp`` with the suffix before; ``code, ch`` of the symbol before the suffix (its row of the transform), with its
    ``occ`` (so far, inclusive), ``c`` (smaller symbols) and ``lf``; ``sym_code`` of the first symbol; ``s_type`` and ``lms``.
    """
    names = names or tuple(COLUMNS)
    return _texts(texts).mapInArrow(_index(names), "text_id bigint, " + ", ".join(f"{n} {COLUMNS[n]}" for n in names))


# --- arrays ----------------------------------------------------------------


def suffix_array(texts: DataFrame, strategy: str = "auto") -> DataFrame:
    """``text_id, rank, pos``, ``n + 1`` rows per text."""
    texts = _texts(texts)
    if strategy == "local":
        return suffix_index(texts, "rank", "pos")
    if strategy == "doubling":
        return suffix_array_doubling(texts)
    local = suffix_index(texts.where(F.length("text") <= LOCAL), "rank", "pos")
    long_ = texts.where(F.length("text") > LOCAL)
    return local if long_.isEmpty() else local.union(suffix_array_doubling(long_))


def suffix_array_doubling(texts: DataFrame) -> DataFrame:
    """Prefix doubling by shuffles, in which no task sorts a text. Every row of ``texts`` is ranked on its own.

    The texts lie one after the other on one line. A first sort by range partitions ranks all suffixes by as many symbols as two
    numbers hold; each round then takes what is still tied to twice the symbols, by the rank of the suffix that lies so far ahead.
    A rank is the place of the first of its ties, so that ranks without ties stay. No join is left to Spark's estimates of
    sizes, which follow the texts' files, not their symbols.
    """
    rows = cut(_texts(texts).withColumn("_row", F.monotonically_increasing_id()))
    # One row per partition.
    sizes = {r[0]: r[1] for r in rows.groupBy(F.shiftright("_row", 33)).agg(F.sum(F.length("text") + F.lit(1).cast("bigint"))).collect()}
    base = dict(zip(sorted(sizes), np.cumsum([0, *(sizes[p] for p in sorted(sizes))]).tolist()))
    kind = rows.schema["text_id"].dataType.simpleString()
    found = rows.mapInArrow(_windows(base), f"text_id {kind}, start bigint, pos bigint, span bigint, a bigint, b bigint")
    ranked = with_first_ordinal(found, "start", "a", "b", name="at", number="ties", without=("a", "b")).withColumn("tied", F.col("ties") > 1).drop("ties")
    last = None
    while not (tied := ranked.where("tied")).isEmpty():
        # A tied suffix has no sentinel among its first symbols, so there is always one ahead.
        ahead = ranked.select("start", F.col("pos").alias("_pos"), F.col("at").alias("b"))
        met = cut(tied.withColumn("_pos", F.col("pos") + F.col("span")).join(ahead.hint("merge"), ["start", "_pos"]).select("text_id", "start", "pos", "span", "at", "b"))
        before = F.sum("n").over(Window.partitionBy("start", "at").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
        keys = met.groupBy("start", "at", "b").agg(F.count("*").alias("n")).select("start", "at", "b", (F.col("at") + F.coalesce(before, F.lit(0))).alias("_at"), (F.col("n") > 1).alias("tied"))
        again = met.join(keys.hint("merge"), ["start", "at", "b"]).select("text_id", "start", "pos", (F.col("span") * 2).alias("span"), F.col("_at").alias("at"), "tied")
        # Files, as a checkpoint would keep the estimate of its size, which a join squares in every round.
        path = scratch(rows.sparkSession)
        ranked.where("NOT tied").select(again.columns).union(again).write.parquet(path)
        ranked = rows.sparkSession.read.parquet(path)
        if last:
            discard(rows.sparkSession, last)
        last = path
    return ranked.select("text_id", (F.col("at") - F.col("start")).alias("rank"), "pos")


def _windows(base: dict[int, int]):
    """Per suffix, ``start`` (of its text on the line) and its first ``span`` symbols as ``a, b``: numbers in the order of the symbols, with zeros from the sentinel on.

    ``base``: where the texts of each partition begin. Codes, and with them ``span``, are the same for all suffixes of a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = None
        for batch in batches:
            done = 0
            if begun is None and batch.num_rows:
                begun = base[batch.column(2)[0].as_py() >> 33]
            for _, held in _batches(batch):
                ids = batch.column(0).slice(done, len(held))
                for own, *columns in _packed(held):
                    columns[0] += begun
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(own)), *map(pa.array, columns)], names=["text_id", "start", "pos", "span", "a", "b"])
                begun += sum(map(len, held)) + len(held)
                done += len(held)

    return run


def _packed(held: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """The number of the text, ``start, pos, span, a, b`` of all suffixes, ``ROWS`` at a time."""
    line = "".join(t + "\n" for t in held)
    sizes = np.array([len(t) + 1 for t in held], np.int64)
    ends = np.cumsum(sizes)
    alphabet = np.array(sorted(map(ord, set(line))), np.uint32)
    bits = len(alphabet).bit_length()
    half = 63 // bits
    for lo in range(0, len(line), ROWS):
        n = min(ROWS, len(line) - lo)
        code = np.zeros(n + 2 * half, np.int64)
        near = symbols(line[lo : lo + len(code)])
        code[: len(near)] = np.searchsorted(alphabet, near) + 1
        last = ends - 1 - lo
        code[last[np.searchsorted(last, 0) : np.searchsorted(last, len(code))]] = 0
        window = np.zeros(n + half, np.int64)
        for k in range(half):
            window = (window << bits) | code[k : k + n + half]
        place = np.arange(lo, lo + n)
        own = np.searchsorted(ends, place, "right")
        begin, left = (ends - sizes)[own], ends[own] - place
        drop = [bits * np.clip(k - left, 0, half) for k in (half, 2 * half)]
        yield own, begin, place - begin, np.full(n, 2 * half), window[:n] >> drop[0] << drop[0], window[half:] >> drop[1] << drop[1]


def inverse_suffix_array(texts: DataFrame) -> DataFrame:
    return suffix_array(texts).select("text_id", "pos", "rank")


def lcp_array(texts: DataFrame) -> DataFrame:
    return suffix_index(texts, "rank", "lcp")


def suffix_types(texts: DataFrame) -> DataFrame:
    """``text_id, pos, s_type``: whether the suffix is smaller than the next one."""
    return suffix_index(texts, "pos", "s_type")


def lms_positions(texts: DataFrame) -> DataFrame:
    """``text_id, pos`` of the leftmost S-type suffixes, the sentinel's included."""
    return suffix_index(texts, "pos", "lms").where("lms").select("text_id", "pos")


def symbol_buckets(texts: DataFrame) -> DataFrame:
    """``text_id, code, n, bucket_beg, bucket_end``: where the suffixes with one first symbol lie among the ranks."""
    n = suffix_index(texts, "sym_code").groupBy("text_id", F.col("sym_code").alias("code")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("text_id").orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("n").over(w)
    return n.select("text_id", "code", "n", (end - F.col("n")).alias("bucket_beg"), end.alias("bucket_end"))


# --- searches --------------------------------------------------------------


def search_rows(search: Callable[[str, np.ndarray, list[str]], list[tuple[int, int]]]):
    """A search of a block of patterns in every text. ``search`` gives rank intervals from a text, its suffix array and patterns."""

    def one(texts: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        shared = texts.sparkSession.sparkContext.broadcast(block)
        schema = pa.schema([(c, pa.int64()) for c in ("text_id", "pattern_id", "rank", "pos")])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = np.array([p for p, _ in shared.value], dtype=object)
            words = [w for _, w in shared.value]
            for batch in batches:
                for owners, held in _batches(batch):
                    x = Index(held)
                    for i, (t, text) in enumerate(zip(owners, held)):
                        sa = x.sa[x.start[i] : x.start[i + 1]] - x.start[i]
                        found = np.array(search(text, sa, words), np.int64).reshape(-1, 2)
                        size = found[:, 1] - found[:, 0]
                        which = np.repeat(np.arange(len(size)), size)
                        rank = found[which, 0] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
                        if len(rank):
                            yield pa.RecordBatch.from_arrays([pa.array([t] * len(rank), pa.int64()), pa.array(ids[which], pa.int64()), pa.array(rank), pa.array(sa[rank])], schema=schema)

        return texts.mapInArrow(run, "text_id bigint, pattern_id bigint, rank bigint, pos bigint")

    return one


def _bisect(text: str, sa: np.ndarray, words: list[str]) -> list[tuple[int, int]]:
    out, pos = [], sa.tolist()
    for w in words:
        m, bounds = len(w), []
        for after in (False, True):
            lo, hi = 0, len(pos)
            while lo < hi:
                mid = (lo + hi) // 2
                part = text[pos[mid] : pos[mid] + m]
                if part < w or (after and part == w):
                    lo = mid + 1
                else:
                    hi = mid
            bounds.append(lo)
        out.append((bounds[0], bounds[1]))
    return out


def sa_search(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``text_id, pattern_id, rank, pos`` of all matches, by binary search in the suffix array; ``rank`` is the suffix order."""
    return over_blocks(_texts(texts), patterns, search_rows(_bisect))


# --- suffix tree -----------------------------------------------------------


def tree_nodes(sa: np.ndarray, lcp: np.ndarray) -> list[list[int]]:
    """``[sa_lo, sa_hi, depth, parent]`` of the nodes of one text's suffix tree in preorder; the root is node 0 and leaves are single ranks.

    Depths count the sentinel, so a leaf is as deep as its suffix is long, plus one.
    """
    n = len(sa)
    size = n - sa  # lengths with the sentinel
    inner: list[list[int]] = []
    open_: list[list[int]] = [[0, 0, 0]]
    for r in range(1, n):
        lo = r - 1
        while open_[-1][2] > lcp[r]:
            node = open_.pop()
            inner.append([node[0], r, node[2]])
            lo = node[0]
        if open_[-1][2] < lcp[r]:
            open_.append([lo, 0, int(lcp[r])])
    while open_:
        node = open_.pop()
        inner.append([node[0], n, node[2]])
    nodes = inner + [[r, r + 1, int(size[r])] for r in range(n)]
    nodes.sort(key=lambda v: (v[0], -v[1], v[2]))
    path: list[int] = []
    for i, v in enumerate(nodes):
        while path and nodes[path[-1]][1] < v[1] or path and nodes[path[-1]][1] <= v[0]:
            path.pop()
        v.append(path[-1] if path else -1)
        path.append(i)
    return nodes


class Tree:
    def __init__(self, text: str, sa: np.ndarray, lcp: np.ndarray):
        self.text, self.sa = text, sa
        self.nodes = tree_nodes(sa, lcp)

    @cached_property
    def children(self) -> list[dict[str, int]]:
        """The children of every node by the symbol that leads there, the sentinel's as an empty string."""
        out: list[dict[str, int]] = [{} for _ in self.nodes]
        for i, (lo, _, _, parent) in enumerate(self.nodes):
            if parent >= 0:
                at = int(self.sa[lo]) + self.nodes[parent][2]
                out[parent][self.text[at : at + 1]] = i
        return out

    def edge(self, i: int) -> tuple[int, int]:
        """Where the label of the edge into a node stands in the text; the sentinel is at the text's length."""
        lo, _, depth, parent = self.nodes[i]
        at = int(self.sa[lo])
        return at + (self.nodes[parent][2] if parent >= 0 else 0), at + depth

    def locate(self, p: str) -> tuple[int, int, str]:
        """The node at or below the place where a pattern ends, the symbols matched, and the outcome."""
        node, done = 0, 0
        while done < len(p):
            child = self.children[node].get(p[done])
            if child is None:
                return node, done, "node mismatch"
            beg, end = self.edge(child)
            label = self.text[beg : min(end, len(self.text))]
            part = p[done : done + end - beg]
            if label[: len(part)] != part:
                same = next((i for i, (a, b) in enumerate(zip(part, label)) if a != b), min(len(part), len(label)))
                return child, done + same, "edge mismatch"
            node, done = child, done + len(part)
            if done == len(p) and len(part) < end - beg:
                return node, done, "edge match"
        return node, done, "node match"


def _trees(batch: pa.RecordBatch) -> Iterator[tuple[object, Tree]]:
    for owners, held in _batches(batch):
        x = Index(held)
        lcp = x.lcp()
        for i, (t, text) in enumerate(zip(owners, held)):
            s = slice(x.start[i], x.start[i + 1])
            yield t, Tree(text, x.sa[s] - x.start[i], lcp[s])


_NODES = ("text_id", "node_id", "parent_id", "depth", "edge_beg", "edge_end", "sa_lo", "sa_hi", "leaf_pos")


def tree(texts: DataFrame) -> DataFrame:
    """The suffix tree: nodes in preorder, ``parent_id`` null for the root, ``leaf_pos`` null for inner nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, tree_ in _trees(batch):
                lo, hi, depth, parent = np.array(tree_.nodes, np.int64).T
                at, root = tree_.sa[lo], parent < 0
                inner = (hi - lo > 1) | (depth != len(tree_.text) + 1 - at)
                columns = [[t] * len(lo), np.arange(len(lo)), parent, depth, at + np.where(root, 0, depth[parent]), at + depth, lo, hi, at]
                masks = [None, None, root, *[None] * 5, inner]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64(), mask=m) for c, m in zip(columns, masks)], names=list(_NODES))

    return _texts(texts).mapInArrow(run, ", ".join(f"{c} bigint" for c in _NODES))


def tree_leaves(texts: DataFrame) -> DataFrame:
    """``text_id, rank, pos``: the leaves, in order of rank."""
    return tree(texts).where("leaf_pos IS NOT NULL").select("text_id", F.col("sa_lo").alias("rank"), F.col("leaf_pos").alias("pos"))


def tree_locate(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``text_id, pattern_id, node_id, matched, outcome, sa_lo, sa_hi``: where the walk of each pattern from the root ends."""
    names = ["text_id", "pattern_id", "node_id", "matched", "sa_lo", "sa_hi"]

    def one(texts: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        shared = texts.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for t, tree_ in _trees(batch):
                    rows = []
                    for p, word in shared.value:
                        node, done, outcome = tree_.locate(word)
                        rows.append((t, p, node, done, *tree_.nodes[node][:2], outcome))
                    if rows:
                        *numbers, outcomes = zip(*rows)
                        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in numbers), pa.array(outcomes, pa.string())], names=[*names, "outcome"])

        return texts.mapInArrow(run, ", ".join(f"{c} bigint" for c in names) + ", outcome string")

    return over_blocks(_texts(texts), patterns, one)


def tree_search(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``text_id, pattern_id, rank, pos``: all leaves below the place where a pattern ends, read from the tree that was walked."""
    schema = pa.schema([(c, pa.int64()) for c in ("text_id", "pattern_id", "rank", "pos")])

    def one(texts: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        shared = texts.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in batches:
                for t, tree_ in _trees(batch):
                    for p, word in shared.value:
                        node, _, outcome = tree_.locate(word)
                        if outcome in ("node match", "edge match"):
                            lo, hi = tree_.nodes[node][:2]
                            held.append((t, p, lo, tree_.sa[lo:hi]))
                            size += hi - lo
                            if size >= ROWS:
                                yield from _leaves(held, schema)
                                held, size = [], 0
            if held:
                yield from _leaves(held, schema)

        return texts.mapInArrow(run, "text_id bigint, pattern_id bigint, rank bigint, pos bigint")

    return over_blocks(_texts(texts), patterns, one)


def _leaves(held: list[tuple[object, object, int, np.ndarray]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of ``(text, pattern, lowest rank, places in order of rank)``."""
    ids, words, lows, places = zip(*held)
    sizes = np.array([len(x) for x in places])
    which, pos = np.repeat(np.arange(len(sizes)), sizes), np.concatenate(places)
    rank = np.arange(len(pos)) + (np.array(lows) - np.cumsum(sizes) + sizes)[which]
    columns = [pa.array(ids, pa.int64()).take(pa.array(which)), pa.array(words, pa.int64()).take(pa.array(which)), pa.array(rank), pa.array(pos)]
    whole = pa.RecordBatch.from_arrays(columns, schema=schema)
    for at in range(0, whole.num_rows, ROWS):
        yield whole.slice(at, ROWS)
