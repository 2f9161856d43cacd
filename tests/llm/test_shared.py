import random

import numpy as np
import pytest

from weftline.functions.sequences import clean
from weftline.llm import shared

SCHEMA = "ord bigint, name string, seq string, seed bigint, beg bigint"


def brute(rows):
    texts = {o: clean(s) for o, _, s, *_ in rows if s is not None and o is not None}
    held = {}
    for o, t in texts.items():
        for i in range(len(t) - 63):
            w = t[i : i + 64]
            if set(w) <= set("ACGT"):
                held.setdefault(w, set()).add(o)
    out = set()
    for o, t in texts.items():
        mark = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - 63):
            if len(held.get(t[i : i + 64], ())) > 1:
                mark[i + 1 : i + 65] = True
        edge = np.flatnonzero(np.diff(mark.astype(int)))
        out |= {(o, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a, b = dna(500), dna(200)
    out = [(1, dna(300) + a + dna(50)), (2, a[100:163] + dna(40)), (3, a[100:164] + dna(40)), (4, b + dna(20) + b), (5, a[:90].lower() + "\n" + a[90:260] + "N" + a[261:400])]
    out += [(6, None), (7, ""), (8, "A" * 400), (9, "A" * 70 + "C" + "A" * 63), (10, "AC" * 100), (11, "CA" * 60), (12, "N" * 200), (13, "N" * 200), (14, dna(64)), (None, a)]
    return [(o, f"n{o}", s, 0, 0) for o, s in [*out, out[0], out[3]]]


@pytest.mark.parametrize("slot_bands, parts", [(1 << 18, 1), (5, 1), (5, 9), (1 << 18, 30)])
def test_spans(spark, rows, slot_bands, parts):
    """Whatever records meet in one worker, and however many slots there are."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = [tuple(r) for r in shared.shared_spans(df, slot_bands).collect()]
    assert set(got) == brute(rows) and len(got) == len(set(got))


def test_hot_bands_travel_twice(rows):
    """Bands with the same symbols in many records of a worker: all runs are known, two bands of different records travel."""
    text = clean(rows[0][2])
    held = [(k, np.full(len(k), o, np.int64), *rest) for o in range(50) for k, *rest in [shared.band_rows(text)]]
    one = len(held[0][0])
    bands, known = shared._split_by_copies(shared._masked(tuple(map(np.concatenate, zip(*held)))))
    assert len(known[0]) == 50 * one and len(bands[0]) == 2 * one and set(bands[1].tolist()) == {0, 49}
    bands, known = shared._split_by_copies(shared._masked(held[0]))
    assert len(known[0]) == 0 and len(bands[0]) == one


def test_blocks(rows):
    text = clean(rows[0][2])
    whole = {(int(p) + i, k) for k, p, n in zip(*(x.tolist() for x in shared.band_rows(text)[:3])) for i in range(n)}
    parts = {(b + int(p) + i, k) for b in range(0, len(text) - 63, 100) for k, p, n in zip(*(x.tolist() for x in shared.band_rows(text[b : b + 163])[:3])) for i in range(n)}
    assert whole == parts and {p for p, _ in whole} == {*range(len(text) - 63)}


def test_parts(spark, rows):
    got = {r.ord: r for r in shared.shared_parts(spark.createDataFrame(rows, SCHEMA)).collect()}
    spans = brute(rows)
    for o, r in got.items():
        own = sorted((a, b) for x, a, b in spans if x == o)
        assert [tuple(s) for s in r.spans] == own and r.shared_len == sum(b - a for a, b in own)
        assert r.shared_part == (r.shared_len / r.clean_len if r.clean_len else None)
    assert set(got) == {r[0] for r in rows if r[0] is not None}
    assert shared.shared_parts(spark.createDataFrame([], SCHEMA)).count() == 0
