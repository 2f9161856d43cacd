import math
import random

import pytest

from weftline.functions.sequences import clean
from weftline.llm import neardup
from weftline.llm.components import components

SCHEMA = "ord bigint, name string, seq string, rep bigint, text string, a bigint"


def windows(s):
    return {s[i : i + 8] for i in range(len(s) - 7)}


def brute(rows):
    texts = {o: windows(clean(s)) for o, _, s, *_ in rows if s and o is not None}
    texts = sorted((o, w) for o, w in texts.items() if w)
    return {(a, b) for i, (a, x) in enumerate(texts) for b, y in texts[i + 1 :] if 2 * len(x & y) >= len(x | y)}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    out, i = [], 0

    def put(s):
        nonlocal i
        i += 1
        out.append((i, "n", s))

    for _ in range(40):
        s = dna(rng.randint(60, 180))
        for _ in range(4):
            t = list(s)
            for _ in range(rng.randint(0, 7)):
                t[rng.randrange(len(t))] = rng.choice("ACGTN")
            put("".join(t))
        put(s)
    for s in (None, "", "ACGT", "ACGT", "ACGTACGT", "acgt acgt", "Ā" * 20 + "ACGTACGT", "Ā" * 21 + "ACGTACGT", "N" * 30, "N" * 31, dna(20_000)):
        put(s)
    hot = dna(100)
    for _ in range(60):
        put(hot)
    out += [out[0], out[7], (None, "n", hot)]
    return [(*r, 1, "t", 2) for r in out]


def test_pairs(spark, rows):
    got = [tuple(r) for r in neardup.record_pairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.998 * len(want)


def test_groups(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.ord: r for r in neardup.groups(df).collect()}
    texts = {o: clean(s) for o, _, s, *_ in rows if s and o is not None}
    assert set(got) == set(texts)
    rep = {o: min(p for p, t in texts.items() if t == texts[o]) for o in texts}
    assert all(got[o].rep == rep[o] for o in got)
    pairs = {tuple(sorted((rep[a], rep[b]))) for a, b in brute(rows) if rep[a] != rep[b]}
    links = {o: sum(rep[o] in p for p in pairs) for o in got}
    assert sum(got[o].links == links[o] for o in got) >= 0.98 * len(got)
    root = {o: o for o in rep.values()}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert sum(got[o].group_id == root[rep[o]] for o in got) >= 0.98 * len(got)


@pytest.mark.parametrize("load", [1, 3, 20])
def test_crowded_prefixes(spark, rows, load):
    """Recall stands where prefixes are descended and texts need further trees."""
    # A third of the texts share a stretch and nothing else.
    rng = random.Random(9)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    tail = dna(50)
    more = [(1000 + i, "n", dna(60) + tail, 1, "t", 2) for i in range(60)]
    got = {tuple(r) for r in neardup.record_pairs(spark.createDataFrame([*rows, *more], SCHEMA), load=load).collect()}
    want = brute([*rows, *more])
    assert got <= want and len(got) >= 0.998 * len(want)


def test_chance_meetings(spark):
    """Reads that share only a foreign tail meet often, and all pairs of a meeting would be the square of their number."""
    rng = random.Random(11)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    tail, one = dna(30), dna(70)
    tailed = [(i, "n", dna(40) + tail, 1, "t", 2) for i in range(800)]
    # Alike texts that meet in prefixes as large stay.
    alike = [(2000 + i, "n", one[:k] + "ACGT"[i % 4] + one[k + 1 :], 1, "t", 2) for i, k in enumerate(rng.choices(range(70), k=60))]
    tailed.append(tailed[0])
    met = [tuple(r) for r in neardup.candidates(spark.createDataFrame([*tailed, *alike], SCHEMA)).collect()]
    assert len(met) == len(set(met)) and sum(b < 2000 for _, b in met) < 30 * 800
    first = {}
    for o, _, s, *_ in alike:
        first.setdefault(s, (o, "n", s))
    want = brute(first.values())
    assert len(want) > 500 and len(want & set(met)) >= 0.998 * len(want)


def test_texts_by_shuffle(spark, rows, monkeypatch):
    """Where too many rows need their texts, these are joined by shuffle."""
    df = spark.createDataFrame(rows, SCHEMA)
    few = {tuple(r) for r in neardup.candidates(df, load=3).collect()}
    monkeypatch.setattr(neardup, "FEW", 0)
    assert few == {tuple(r) for r in neardup.candidates(df, load=3).collect()}


def test_marks():
    """Bit sets rule no similar pair out, and nearly all pairs of reads with one foreign tail."""
    import numpy as np

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    x = [word(rng.randint(1, 300)) for _ in range(400)] + ["A" * 40, "", word(5000)]
    y = [t[rng.randint(0, len(t) // 3) :] + word(rng.randint(0, len(t) // 3)) for t in x]
    (mx, nx), (my, ny) = neardup.marks(x), neardup.marks(y)
    for s in (0.3, 0.5, 0.8):
        assert neardup.near(mx, my, nx + ny, s)[neardup.similar(x, y) >= s].all()
    tail = word(25)
    mark, n = neardup.marks([word(100) + tail for _ in range(200)])
    a, b = np.triu_indices(200, 1)
    assert neardup.near(mark[a], mark[b], n[a] + n[b], 0.5).mean() < 0.001


def test_leaves():
    import numpy as np

    rng = np.random.default_rng(1)
    for deep in (rng.integers(0, 1 << 63, 500, np.uint64), np.full(500, 7, np.uint64), np.sort(rng.integers(0, 4, 500).astype(np.uint64) << np.uint64(48))):
        found = sorted(neardup.leaves(np.sort(deep), 0.5, 10))
        assert found[0][0] == 0 and found[-1][1] == 500 and all(a[1] == b[0] for a, b in zip(found, found[1:]))
        assert all(neardup.DEPTH <= d <= neardup.DEEPEST for _, _, d in found)
    assert [*neardup.leaves(np.full(500, 7, np.uint64), 0.5, 10)] == [(0, 500, neardup.DEPTH)]


def test_packed_texts():
    import pyarrow as pa

    rng = random.Random(3)
    some = ["", "A", "ACGT", "ACGTA", "NACG", "Ā", "T" * 1000, "acgt"] + ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(some, kind)
        for part in (column, column[3:50], column[:0]):
            packed = neardup.packed_texts(part)
            assert neardup.unpacked_texts(packed) == part.to_pylist() and len(set(packed.to_pylist())) == len(set(part.to_pylist()))
            assert neardup.unpacked_texts(packed[2:]) == part.to_pylist()[2:]
    assert len(neardup.packed_texts(pa.array(["T" * 1000]))[0].as_py()) == 251


def test_shape_and_similarity():
    for s in (0.5, 0.8, 1.0):
        assert 1 - math.exp(-neardup.forest_size(s) * neardup.weight(neardup.DEPTH, s)) >= neardup.RECALL
    rng = random.Random(6)
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(1, 60)))
    for alphabet in ("ACGT", "ACā", "a b"):
        x = [word(alphabet) for _ in range(100)]
        y = [t[: rng.randint(1, 60)] + word(alphabet)[:5] for t in x]
        got = neardup.similar(x, y)
        for a, b, g in zip(x, y, got):
            u = windows(a) | windows(b)
            assert g == pytest.approx(len(windows(a) & windows(b)) / len(u) if u else 0)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 205), (203, 205)]
    got, _ = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    want = {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 200: 200, 203: 200, 205: 200}
    assert {r.node: r.component for r in got.collect()} == want


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert neardup.record_pairs(none).count() == neardup.groups(none).count() == 0
