"""Problem 3: near-duplicate sequences by a MinHash LSH forest with exact verification.

1. Records with the same clean text are one text (``rep``, the least ``ord``).
2. Every text has one label per tree: a sequence of min-hashes of its windows,
   of which the trie of a tree is made. The subtrees below ``DEPTH`` min-hashes
   are sorted first: a label of that prefix and the text travel in compact
   sorted containers, and texts next to each other with one prefix are candidates.
3. Texts that meet by chance, such as reads with one foreign tail, grow as the
   square of the collection. So from a prefix that more than ``CLOSE`` texts share
   no pair is sent: its texts are fetched once each, as bit sets of their windows,
   and only pairs whose bit sets do not rule the similarity out are candidates.
   A prefix that more than ``LOAD`` texts share is crowded, and its subtree is
   descended: the following min-hashes of its texts, up to ``DEEPEST``, are made
   and sorted. A node is a leaf where at most ``LOAD`` texts are left, or where
   the next min-hash agrees so often that the texts are alike and not there by
   chance. Texts in one leaf are candidates under the same condition.
4. At similarity s a text meets a like one in a leaf of depth d with probability
   s**d. A text whose leaves were deep has not reached the target recall by the
   trees so far; it goes on with further trees, in which it again stops at the
   shortest prefix that isn't crowded, until the sum over its trees does reach
   it. All others are done after the first trees.
5. Candidates are deduplicated, and each is verified on the exact window sets.

The number of trees, the depths and the load are the same for every size of the
collection. Pairs of copies follow from membership alone. Results for odd input:
records with a null or empty sequence take no part; one shorter than a window has
no windows and no pair; redelivered rows (same ``ord``) count once; rows with a
null ``ord`` take no part; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.sequences import clean_seq, symbols
from weftline.llm.components import components
from weftline.plans.lineage import cut

WINDOW, SIMILARITY, RECALL, DEPTH, DEEPEST, LOAD, CLOSE, MARK = 8, 0.5, 0.998, 4, 8, 256, 8, 512
SLOT_ROWS, FLUSH_ROWS, PAIR_ROWS, READ_ROWS, LABEL, FEW = 250_000, 200_000, 1 << 18, 512, 27, 200_000


def weight(depth: int, similarity: float = SIMILARITY) -> float:
    """What a leaf at this depth adds to a text's recall, as the negative logarithm of missing a text just at the threshold."""
    return -math.log1p(-(min(similarity, 1 - 1e-9) ** depth))


def forest_size(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Trees with leaves at ``DEPTH`` that reach the recall at the threshold."""
    return math.ceil(-math.log(1 - recall) / weight(DEPTH, similarity))


# --- texts -----------------------------------------------------------------

_BASES = np.full(256, 4, np.uint8)
_BASES[[ord(c) for c in "ACGT"]] = [0, 1, 2, 3]
_FOUR = np.frombuffer(b"ACGT", np.uint8)[(np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3]
RAW = 255


def _flat(column: pa.Array, kind: pa.DataType) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls and where each value begins, and the end."""
    column = column.cast(kind)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def packed_texts(column: pa.Array) -> pa.Array:
    """Texts of A, C, G, T with four symbols a byte, others as they are; the first byte tells which, and how full the last one is."""
    data, at = _flat(column, pa.string())
    n = np.diff(at)
    data = data[at[0] : at[-1]]
    code = _BASES[data]
    odd = np.concatenate(([0], np.cumsum(code == 4)))
    plain = odd[at[1:] - at[0]] == odd[at[:-1] - at[0]]
    size = 1 + np.where(plain, -(-n // 4), n)
    to = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(int(to[-1]), np.uint8)
    out[to[:-1]] = np.where(plain, n & 3, RAW)
    place = np.arange(len(data)) - np.repeat(at[:-1] - at[0], n)
    begin, four = np.repeat(to[:-1] + 1, n), np.repeat(plain, n)
    for k in range(4):
        some = four & (place & 3 == k)
        out[begin[some] + (place[some] >> 2)] |= code[some] << np.uint8(2 * k)
    out[begin[~four] + place[~four]] = data[~four]
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(out)])


def unpacked_texts(column: pa.Array) -> list[str]:
    data, at = _flat(column, pa.binary())
    if not len(column):
        return []
    whole = _FOUR[data[at[0] : at[-1]]].tobytes().decode("ascii")
    head = data[at[:-1]].astype(np.int64)
    n = np.where(head == 0, (np.diff(at) - 1) * 4, (np.diff(at) - 2) * 4 + head)
    begin = (at[:-1] - at[0] + 1) * 4
    return [whole[b : b + k] if h != RAW else data[x + 1 : y].tobytes().decode() for b, k, h, x, y in zip(begin.tolist(), n.tolist(), head.tolist(), at[:-1].tolist(), at[1:].tolist())]


def _unpacked_any(column: pa.Array) -> list[str]:
    return unpacked_texts(column) if pa.types.is_binary(column.type) else column.to_pylist()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), packed_texts(batch.column(1))], names=["ord", "text"])


def _pack_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a batch once, with its least ``ord``, so that hot copies do not travel one by one."""
    for batch in _pack(batches):
        once = pa.Table.from_batches([batch]).group_by("text").aggregate([("ord", "min")])
        yield from once.select(["ord_min", "text"]).rename_columns(["ord", "text"]).combine_chunks().to_batches()


# --- windows ---------------------------------------------------------------


def _lanes(texts: list[str], width: int, bits: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Window codes of all texts, text after text, and how many each has. Codes are exact for symbols below 256 and ``width`` 8.

    ``bits`` 5 makes shorter codes where all symbols are from ``@`` to ``_``.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    joined = "".join(texts)
    s = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(0, len(s) - width + 1)
    code = np.zeros(n, np.uint64)
    wide = bool(len(s)) and int(s.max()) > 255
    for j in range(width):
        code = (code << np.uint64(bits)) | (s[j : j + n] & np.uint64((1 << bits) - 1))
    if wide or width > 8:
        poly = np.zeros(n, np.uint64)
        for j in range(width):
            poly = poly * np.uint64(0x9E3779B97F4A7C15) + s[j : j + n] + np.uint64(1)
        over = np.concatenate(([0], np.cumsum(s > 255)))
        code = poly if width > 8 else np.where(over[width:] > over[:n], poly, code)
    counts = np.maximum(lengths - width + 1, 0)
    ends = np.cumsum(lengths)
    keep = np.ones(n, bool)
    # Windows that run over the end of a text are none.
    for j in range(1, width):
        at = ends[:-1] - j
        keep[at[(at >= 0) & (at < n)]] = False
    short = (lengths < width) & (lengths > 0)
    for i in np.flatnonzero(short):
        keep[max(0, ends[i] - lengths[i]) : max(0, min(n, ends[i]))] = False
    return code[keep], counts


def _mix(code: np.ndarray) -> np.ndarray:
    x = code * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


@lru_cache(1024)
def _functions(tree: int) -> tuple[np.ndarray, np.ndarray]:
    """The parameters of a tree's hash functions, by depth."""
    rng = np.random.default_rng((20_240_601, tree))
    return rng.integers(0, 1 << 32, DEEPEST, np.uint32), rng.integers(0, 1 << 31, DEEPEST, np.uint32) * np.uint32(2) + np.uint32(1)


def _matrices(texts: list[str], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts of like length, and the hashes of their windows as a matrix, padded with the first window."""
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] >= width]
    at = 0
    while at < len(order):
        step = max(1, min(READ_ROWS, (1 << 17) // max(1, int(lengths[order[at]]))))
        some = order[at : at + step]
        at += step
        code, counts = _lanes([texts[i] for i in some], width)
        start = np.concatenate(([0], np.cumsum(counts)[:-1]))
        column = np.arange(int(counts.max()))
        yield some, _mix(code)[start[:, None] + np.where(column < counts[:, None], column, 0)]


def _least(h: np.ndarray, tree: int, depth: int, buffer: np.ndarray) -> np.ndarray:
    """The min-hash of every text at one depth of a tree."""
    flip, times = _functions(tree)
    np.bitwise_xor(h, flip[depth], out=buffer)
    np.multiply(buffer, times[depth], out=buffer)
    return buffer.min(axis=1)


def labels(texts: list[str], trees: range, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit label of the first ``DEPTH`` min-hashes of each tree (row: text), and which texts have windows."""
    out = np.zeros((len(texts), len(trees)), np.uint64)
    has = np.zeros(len(texts), bool)
    for some, h in _matrices(texts, width):
        has[some] = True
        buffer = np.empty_like(h)
        for column, tree in enumerate(trees):
            label = np.zeros(len(some), np.uint64)
            for d in range(DEPTH):
                label = (label ^ _least(h, tree, d, buffer)) * np.uint64(0xD6E8FEB86659FD93)
                label ^= label >> np.uint64(32)
            out[some, column] = label
    return out, has


def deeper(texts: list[str], tree: int, width: int = WINDOW) -> np.ndarray:
    """The min-hashes of a tree that follow ``DEPTH``, 16 bits each, the first on top: in sorted order this is the trie."""
    out = np.zeros(len(texts), np.uint64)
    for some, h in _matrices(texts, width):
        buffer = np.empty_like(h)
        for d in range(DEPTH, DEEPEST):
            least = _least(h, tree, d, buffer).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            out[some] = (out[some] << np.uint64(16)) | (least >> np.uint64(48))
    return out


def marks(texts: list[str], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """A set of ``MARK`` bits of the windows of each text (row: text), and how many windows it has, equal ones included."""
    out = np.zeros((len(texts), MARK // 64), np.uint64)
    for some, h in _matrices(texts, width):
        bits = np.zeros((len(some), MARK), bool)
        bits[np.arange(len(some))[:, None], h % np.uint32(MARK)] = True
        out[some] = np.packbits(bits, axis=1).view(np.uint64)
    return out, np.array([max(0, len(t) - width + 1) for t in texts], np.int64)


def near(x: np.ndarray, y: np.ndarray, windows: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of bit sets may belong to texts that are similar; ``windows``: of both texts. None that is similar is ruled out.

    Bits that differ are at most the windows that differ, and these at most so large a part of the windows of both.
    """
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= windows * ((1 - similarity) / (1 + similarity)) + 1e-6


# --- containers ------------------------------------------------------------


def _packed(a: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _unpacked(b: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


_FOUND = pa.schema([("tree", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_FOUND_SQL = "tree bigint, a bigint, b bigint"


def _forest(trees: range, ranges: int, width: int):
    schema = pa.schema([("slot", pa.int64()), ("label", pa.binary()), ("rep", pa.binary())])

    def write(reps: np.ndarray, lab: np.ndarray) -> pa.RecordBatch:
        rows: list[tuple] = []
        for column, tree in enumerate(trees):
            # The top bits choose the range, LABEL of the others stay as the label: a chance meeting of labels only adds a candidate.
            one = lab[:, column]
            slot = ((one >> np.uint64(40)) * np.uint64(ranges)) >> np.uint64(24)
            short = (one & np.uint64((1 << LABEL) - 1)).astype(np.uint32)
            order = np.argsort((slot << np.uint64(LABEL)) | short, kind="stable")
            cuts = np.searchsorted(slot[order], np.arange(ranges + 1, dtype=np.uint64))
            rows += [(tree * ranges + r, _packed(np.diff(short[order[a:b]], prepend=np.uint32(0))), _packed(reps[order[a:b]])) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            lab, has = labels(_unpacked_any(batch.column(1)), trees, width)
            held.append((batch.column(0).to_numpy()[has], lab[has]))
            if sum(len(x[0]) for x in held) >= FLUSH_ROWS:
                yield write(*map(np.concatenate, zip(*held)))
                held = []
        if sum(len(x[0]) for x in held):
            yield write(*map(np.concatenate, zip(*held)))

    return run


def _pairs(rep: np.ndarray, size: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """All pairs of neighbours in groups of the given sizes that ``keep`` keeps, in batches of bounded size however many meet."""
    rest = np.repeat(np.cumsum(size), size) - np.arange(len(rep)) - 1  # partners after each entry
    upto = np.cumsum(rest)
    at = 0
    while at < len(rest):
        before = int(upto[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(upto, before + PAIR_ROWS, "right")))
        some = rest[at:to]
        a = np.repeat(np.arange(at, to), some)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(some) - some, some)
        if keep is not None:
            some = keep(a, b)
            a, b = a[some], b[some]
        if len(a):
            x, y = rep[a], rep[b]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), -1)), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=_FOUND)
        at = to


def _meetings(ranges: int, close: int):
    """Texts with the same prefix, tree by tree and range by range: pairs (tree -1), or the texts ``a`` of a prefix ``b`` of more than ``close``."""

    def met(slot: int, labs: list[np.ndarray], reps: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        lab, rep = np.concatenate(labs), np.concatenate(reps)
        order = np.argsort(lab, kind="stable")
        lab, rep = lab[order], rep[order]
        first = np.flatnonzero(np.concatenate(([True], lab[1:] != lab[:-1])))
        size = np.diff(np.append(first, len(lab)))
        many = np.repeat(size > close, size)
        yield from _pairs(rep[~many], size[size <= close])
        if many.any():
            node = (np.int64(slot % ranges) << np.int64(LABEL)) | lab[many].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), slot // ranges)), pa.array(rep[many]), pa.array(node)], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, labs, reps = None, [], []
        for batch in batches:
            for now, lab, rep in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if now != slot and labs:
                    yield from met(slot, labs, reps)
                    labs, reps = [], []
                slot = now
                labs.append(np.cumsum(_unpacked(lab, np.uint32), dtype=np.uint32))
                reps.append(_unpacked(rep, np.int64))
        if labs:
            yield from met(slot, labs, reps)

    return run


def _marked(width: int):
    """The texts of shared prefixes as the min-hashes that follow and as bit sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, texts_ = batch.column(0).to_numpy(), _unpacked_any(batch.column(3))
            key = np.zeros(len(tree), np.uint64)
            for t in np.unique(tree).tolist():
                at = np.flatnonzero(tree == t)
                key[at] = deeper([texts_[i] for i in at], t, width)
            mark, windows = marks(texts_, width)
            each = np.arange(len(tree) + 1, dtype=np.int32) * np.int32(MARK // 8)
            mark = pa.Array.from_buffers(pa.binary(), len(tree), [None, pa.py_buffer(each), pa.py_buffer(mark)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(key.view(np.int64)), pa.array(windows), mark], names=["tree", "a", "b", "deep", "windows", "mark"])

    return run


def leaves(deep: np.ndarray, similarity: float, load: int = LOAD) -> Iterator[tuple[int, int, int]]:
    """Begin, end and depth of the leaves of a crowded prefix, from the sorted min-hashes that follow it."""
    todo = [(0, len(deep), DEPTH)]
    while todo:
        lo, hi, depth = todo.pop()
        m = hi - lo
        if m > load and depth < DEEPEST:
            symbol = (deep[lo:hi] >> np.uint64(16 * (DEEPEST - 1 - depth))) & np.uint64(0xFFFF)
            cuts = np.flatnonzero(np.concatenate(([True], symbol[1:] != symbol[:-1])))
            size = np.diff(np.append(cuts, m))
            # Pairs at the threshold agree in the next min-hash as often as they are similar.
            if float((size * (size - 1)).sum()) < similarity / 2 * m * (m - 1):
                todo += [(lo + c, lo + c + n, depth + 1) for c, n in zip(cuts.tolist(), size.tolist())]
                continue
        yield lo, hi, depth


def _descend(similarity: float, load: int):
    """Pairs (tree -1) of the leaves below each shared prefix that may be similar, and the texts ``a`` whose leaf is at depth ``b`` (tree 0)."""

    def met(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        rep, deep, windows, mark = map(np.concatenate, zip(*parts))
        _, once = np.unique(rep, return_index=True)  # redelivered rows once
        deep = deep.view(np.uint64)
        order = once[np.argsort(deep[once], kind="stable")]
        rep, deep = rep[order], deep[order]
        found = np.array([*leaves(deep, similarity, load)], np.int64).reshape(-1, 3)
        found = found[np.argsort(found[:, 0])]
        size = found[:, 1] - found[:, 0]
        yield from _pairs(rep, size, lambda a, b: near(mark[order[a]], mark[order[b]], windows[order[a]] + windows[order[b]], similarity))
        depth = np.repeat(found[:, 2], size)
        late = depth > DEPTH
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(int(late.sum()), np.int64)), pa.array(rep[late]), pa.array(depth[late])], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, parts = None, []
        for batch in batches:
            tree, rep, label, deep, windows = (batch.column(i).to_numpy() for i in range(5))
            data, at = _flat(batch.column(5), pa.binary())
            mark = np.frombuffer(data[at[0] : at[-1]].tobytes(), np.uint64).reshape(len(tree), -1)
            cuts = np.flatnonzero(np.concatenate(([True], (tree[1:] != tree[:-1]) | (label[1:] != label[:-1]))))
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(tree)]):
                now = (int(tree[lo]), int(label[lo]))
                if now != node and parts:
                    yield from met(parts)
                    parts = []
                node = now
                parts.append((rep[lo:hi], deep[lo:hi], windows[lo:hi], mark[lo:hi]))
        if parts:
            yield from met(parts)

    return run


# --- verification ----------------------------------------------------------


def similar(left: list[str], right: list[str], width: int = WINDOW) -> np.ndarray:
    """Shared distinct windows over all distinct windows of each pair of texts."""
    n = len(left)
    s = symbols("".join(left) + "".join(right))
    plain = width == 8 and len(s) > 0 and int(s.min()) >= 64 and int(s.max()) < 96
    codes, counts = zip(_lanes(left, width, 5 if plain else 8), _lanes(right, width, 5 if plain else 8))
    owner = np.concatenate([np.repeat(np.arange(n), c) for c in counts])
    side = np.concatenate([np.zeros(len(codes[0]), np.uint64), np.ones(len(codes[1]), np.uint64)])
    code = np.concatenate(codes)
    if not len(code):
        return np.zeros(n)
    if not plain:
        code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
    # Pair, code and side in one number, so that one plain sort brings equal windows of a pair together.
    key = (owner.astype(np.uint64) << np.uint64(42)) | (code << np.uint64(1)) | side
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    both = np.flatnonzero((key[1:] >> np.uint64(1)) == (key[:-1] >> np.uint64(1)))
    pair = (key >> np.uint64(42)).astype(np.int64)
    total, shared = np.bincount(pair, minlength=n), np.bincount(pair[both], minlength=n)
    return shared / np.maximum(total - shared, 1)


def _verify(similarity: float, width: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = unpacked_texts(batch.column(2)), unpacked_texts(batch.column(3))
            ok = np.zeros(len(left), bool)
            for at in range(0, len(left), 4096):
                ok[at : at + 4096] = similar(left[at : at + 4096], right[at : at + 4096], width) >= similarity
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=schema)

    return run


# --- operator --------------------------------------------------------------


def _keyed(reads: DataFrame) -> DataFrame:
    return reads.select("ord", clean_seq(F.col("seq")).alias("text")).where("text <> '' AND ord IS NOT NULL")


def _partitions(df: DataFrame) -> int:
    """The number of partitions is given where rows are small and the work on them is not."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def texts(reads: DataFrame) -> DataFrame:
    """``rep, text``: each distinct clean text, packed, with the least ``ord`` that has it."""
    packed = _keyed(reads).mapInArrow(_pack_once, "ord bigint, text binary")
    return packed.repartition(_partitions(reads), "text").groupBy("text").agg(F.min("ord").alias("rep")).select("rep", "text")


def _hash(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def copies(reads: DataFrame, width: int = WINDOW) -> DataFrame:
    """``ord, rep, has`` of every record whose clean text another record has as well; ``has``: whether it has windows.

    Texts are met by 128-bit hashes, aggregated before the shuffle. While the hashes met more than once are few, they are sent to
    where the records lie; beyond ``FEW`` rows the two sides are joined by shuffle, and skewed parts split.
    """
    keyed = _keyed(reads).select(*_hash("text"), (F.length("text") >= width).alias("has"), "ord")
    reps = cut(keyed.groupBy("h1", "h2").agg(F.min("ord").alias("rep"), F.max("ord").alias("last")).where("rep <> last").drop("last"))
    reps = F.broadcast(reps) if reps.count() <= FEW else reps
    return keyed.join(reps, ["h1", "h2"]).select("ord", "rep", "has").distinct()


def _fetched(some: DataFrame, reads: DataFrame) -> DataFrame:
    """``some`` with the text of ``a``, as it is or packed: few rows are sent to where the records lie, many are joined by shuffle."""
    if some.count() <= FEW:
        return reads.select("ord", "seq").join(F.broadcast(some), F.col("ord") == F.col("a")).select(*some.columns, clean_seq(F.col("seq")).alias("text")).where("text <> ''")
    return _by_ord(reads).join(some, F.col("ord") == F.col("a")).select(*some.columns, "text")


def candidates(reads: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, width: int = WINDOW, load: int = LOAD) -> DataFrame:
    """``a, b`` (``a < b``): texts that lie in one leaf of some tree, without such as bit sets of their windows rule out."""
    rest, n = texts(reads), reads.count()
    size, ranges, target = forest_size(similarity, recall), -(-max(1, n) // SLOT_ROWS), -math.log(1 - recall)
    lost, pairs, first = None, None, 0
    while True:
        trees = range(first, first + size)
        first += size
        forest = rest.mapInArrow(_forest(trees, ranges, width), "slot bigint, label binary, rep binary")
        found = cut(forest.repartition("slot").sortWithinPartitions("slot").mapInArrow(_meetings(ranges, min(CLOSE, load)), _FOUND_SQL).distinct())
        met, shared = found.where("tree < 0").select("a", "b"), found.where("tree >= 0")
        alone = shared.isEmpty()
        pairs = met if pairs is None else pairs.union(met)
        if alone:
            break
        deep = _fetched(shared, reads).mapInArrow(_marked(width), "tree bigint, a bigint, b bigint, deep bigint, windows bigint, mark binary")
        below = cut(deep.repartition("tree", "b").sortWithinPartitions("tree", "b").mapInArrow(_descend(similarity, load), _FOUND_SQL))
        pairs = pairs.union(below.where("tree < 0").select("a", "b"))
        late = below.where("tree = 0")
        if late.isEmpty():  # no text lost recall to these trees, so all have reached the target
            break
        less = F.lit(0.0)
        for d in range(DEPTH + 1, DEEPEST + 1):
            less = F.when(F.col("b") == d, weight(DEPTH, similarity) - weight(d, similarity)).otherwise(less)
        now = late.select(F.col("a").alias("rep"), less.alias("lost"))
        lost = cut((now if lost is None else lost.union(now)).groupBy("rep").agg(F.sum("lost").alias("lost")))
        late = lost.where(first * weight(DEPTH, similarity) - F.col("lost") < target).select("rep")
        if late.isEmpty():
            break
        rest = _fetched(late.select(F.col("rep").alias("a")), reads).repartition(_partitions(reads), "a").distinct()
    return pairs.distinct() if first > size or not alone else pairs


def _by_ord(reads: DataFrame) -> DataFrame:
    """``ord, text``: every record with its packed text, by ``ord``; redelivered rows once."""
    return _keyed(reads).mapInArrow(_pack, "ord bigint, text binary").repartition(_partitions(reads), "ord").distinct()


def text_pairs(reads: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, width: int = WINDOW, load: int = LOAD) -> DataFrame:
    """``a, b`` (``a < b``): pairs of different texts, named by ``rep``, whose window sets are at least ``similarity`` alike."""
    met = candidates(reads, similarity, recall, width, load)
    # Texts are fetched by the number that names them, in one shuffle for both sides.
    of = _by_ord(reads)
    left, right = (of.select(F.col("ord").alias(c), F.col("text").alias(t)) for c, t in (("a", "left"), ("b", "right")))
    both = met.join(right, "b").join(left, "a").select("a", "b", "left", "right")
    return both.mapInArrow(_verify(similarity, width), "a bigint, b bigint")


def record_pairs(reads: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, width: int = WINDOW, load: int = LOAD) -> DataFrame:
    """``ord_a, ord_b`` (``ord_a < ord_b``): all pairs of records at least ``similarity`` alike, copies included."""
    pairs, same = text_pairs(reads, similarity, recall, width, load), cut(copies(reads, width))
    one, two = same.select(F.col("ord").alias("m1"), F.col("rep").alias("a")), same.select(F.col("ord").alias("m2"), F.col("rep").alias("b"))
    wide = pairs.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("m1", "a").alias("x"), F.coalesce("m2", "b").alias("y"))
    between = wide.select(F.least("x", "y").alias("ord_a"), F.greatest("x", "y").alias("ord_b"))
    # Texts shorter than a window have no windows that could be shared.
    long_copies = same.where("has")
    within = long_copies.select(F.col("ord").alias("ord_a"), "rep").join(long_copies.select(F.col("ord").alias("ord_b"), "rep"), "rep").where("ord_a < ord_b").select("ord_a", "ord_b")
    return between.union(within)


def groups(reads: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, width: int = WINDOW, load: int = LOAD) -> DataFrame:
    """``ord, rep, group_id, links``: every record with its text, the group of texts linked to it, and the number of other texts alike.

    One row per record, copies not expanded; a record that is like no other is its own group. Records without a sequence are left out.
    """
    pairs = text_pairs(reads, similarity, recall, width, load)
    group, pairs = components(pairs)
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    every = _keyed(reads).select("ord").distinct().join(copies(reads, width), "ord", "left").select("ord", F.coalesce("rep", "ord").alias("rep"))
    return every.join(links, "rep", "left").join(group.select(F.col("node").alias("rep"), F.col("component")), "rep", "left").select("ord", "rep", F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
