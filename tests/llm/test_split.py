import random
import re

import pytest

from weftline.functions.sequences import clean
from weftline.llm import split

SCHEMA = "ord bigint, name string, seq string, piece string, block_no int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ACGTacgt \t\r\n") for _ in range(n))
    # Two records without a number are two records.
    out = [(None, "m", word(2500) + "N" * 20), (1, "a", None), (2, "b", ""), (3, "c", " \n"), (4, "d", "ACGT"), (5, "e", "N" * 9000), (6, "f", word(12000)), (None, "n", word(5000))]
    for i in range(10, 22):
        out.append((i, "g", "".join(word(rng.randint(1, 900)) + rng.choice("NnXR-.é") * rng.choice([1, 5, 9, 10, 11, 60, 1500]) for _ in range(12))))
    return [(*r, "x", 1) for r in [*out, out[-1], out[5]]]


def brute(rows):
    found = set()
    for o, _, seq, *_ in rows:
        s = clean(seq or "")
        if len(s) > 2000:
            gaps = [m.span() for m in re.finditer("[^ACGT]{10,}", s)]
            found |= {(o, *g) for g in gaps or [(-1, -1)]}
    return found


@pytest.mark.parametrize("block", [64, 1000, 1 << 16])
def test_gaps(spark, rows, block):
    got = [tuple(r) for r in split.gaps(spark.createDataFrame(rows, SCHEMA), block=block).collect()]
    assert set(got) == brute(rows) and len(got) == len(set(got))


@pytest.mark.parametrize("block", [700, 1 << 16])
def test_pieces(spark, rows, block):
    by = {}
    for r in split.pieces(spark.createDataFrame(rows, SCHEMA).where("ord IS NOT NULL OR name = 'n'"), block=block).collect():
        by.setdefault(r.ord, []).append(r)
    texts = {r[0]: clean(r[2]) for r in rows if r[2] is not None and clean(r[2]) and r[1] != "m"}
    assert set(by) == set(texts)
    for o, text in texts.items():
        got = sorted(by[o], key=lambda r: r.piece_no)
        gaps = [m.span() for m in re.finditer("[^ACGT]{10,}", text)]
        assert [r.piece_no for r in got] == [*range(len(got))] and got[0].piece_beg == 0 and got[-1].piece_end == len(text)
        for i, r in enumerate(got):
            assert r.piece == text[r.piece_beg : r.piece_end] and 0 < len(r.piece) <= 2000
            if i:
                assert r.piece_beg == got[i - 1].piece_end - 100
            if i < len(got) - 1:
                reach = [min(e, r.piece_beg + 2000) for b, e in gaps if b <= r.piece_beg + 2000 and min(e, r.piece_beg + 2000) > r.piece_beg + 100]
                assert r.at_gap == bool(reach) and r.piece_end == (max(reach) if reach else r.piece_beg + 2000)


def test_records_without_a_number(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).where("ord IS NULL")
    got = split.pieces(df.union(df)).collect()
    want = {clean(r[2])[:10] for r in rows if r[0] is None}
    assert {r.piece[:10] for r in got if r.piece_no == 0} == want and sum(r.piece_no == 0 for r in got) == 2


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert split.gaps(none).count() == split.pieces(none).count() == 0
    with pytest.raises(ValueError):
        split.pieces(none, 100, 100)
