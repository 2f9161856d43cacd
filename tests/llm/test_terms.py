import random
from collections import Counter

import pytest

from weftline.functions.sequences import clean
from weftline.llm import terms

SCHEMA = "ord bigint, name string, seq string, term string, route bigint"


def rows():
    rng = random.Random(8)
    out = [(i, "n", "".join(rng.choice("ACGTacgtN \n") for _ in range(rng.randint(0, 90)))) for i in range(120)]
    out += [(200, "a", None), (201, "b", ""), (202, "c", "ACG"), (203, "é", "ACGTĀACGTACGTACGé"), (204, "p", "A" * 500), (None, "q", "ACGTACGTACGTACG"), out[0], out[1]]
    return [(*r, "t", 1) for r in out]


@pytest.mark.parametrize("k", [1, 4, 10, 16, 31])
def test_counts(spark, k):
    data = rows()
    records = {(o, s) for o, _, s, *_ in data if s is not None}
    occ, rec = Counter(), Counter()
    for _, s in records:
        t = clean(s)
        found = [t[i : i + k] for i in range(len(t) - k + 1) if set(t[i : i + k]) <= set("ACGT")]
        occ.update(found)
        rec.update(set(found))
    got = terms.marked_terms(spark.createDataFrame(data, SCHEMA), k, 10).collect()
    assert {r.term: (r.occurrences, r.records) for r in got} == {t: (occ[t], rec[t]) for t in occ} and len(got) == len(occ)
    for r in got:
        assert r.mark == ("rare" if rec[r.term] == 1 else "common" if rec[r.term] * 10 >= len(records) else None)


def brute(texts, k):
    return Counter(t[i : i + k] for t in map(clean, texts) for i in range(len(t) - k + 1) if set(t[i : i + k]) <= set("ACGT"))


def test_flushed_workers(spark, monkeypatch):
    monkeypatch.setattr(terms, "FLUSH", 50)
    import numpy as np
    import pyarrow as pa

    texts = [r[2] for r in rows() if r[2]]
    parts = [*terms._count(10, 20)(iter([pa.RecordBatch.from_arrays([pa.array([t])], names=["seq"]) for t in texts]))]
    assert len(parts) > 1
    starts = terms.routes([(0, 0), (1, 2), (2, 9)], 10)
    routed = pa.Table.from_batches([*terms._routed(starts)(iter(parts))]).sort_by("route")
    joined = pa.Table.from_batches([*terms._merged(10)(iter(routed.to_batches(max_chunksize=7)))])
    assert dict(zip(joined["term"].to_pylist(), joined["occurrences"].to_pylist())) == dict(brute(texts, 10))
    assert joined.num_rows == len(brute(texts, 10)) and set(np.diff(starts)) == {4**9, 4**8, 4**7}


@pytest.mark.parametrize("k", [5, 31])
def test_hot_prefix(spark, k):
    """A prefix under which most terms lie becomes many routes, none much above the load."""
    import numpy as np

    rng = random.Random(3)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    texts = [("AAAAAAAA" + dna(40)) * 3 for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ord bigint, seq string").repartition(6)
    containers = df.select("seq").mapInArrow(terms._count(k, 16), terms._PARTIAL_SQL)
    crowded = terms.crowded_prefixes(containers, k, 400)
    starts = terms.routes(crowded, k)
    if k == 31:
        assert max(d for d, _ in crowded) == 8
    held = containers.mapInArrow(terms._routed(starts), "route bigint, codes binary, occ binary, rec binary").collect()
    load = Counter()
    for r in held:
        load[r.route] += len(terms._unpacked(r.codes))
    assert max(load.values()) <= 400 + 6 * 16
    got = terms.term_frequencies(df, k, 16, 400).collect()
    assert {r.term: r.occurrences for r in got} == dict(brute(texts, k)) and len(got) == len(brute(texts, k))
    assert sorted(b - a for a, b, _ in terms.leaves(np.arange(4**5), 5, 16)) == [16] * 64


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert terms.marked_terms(none).count() == 0
    with pytest.raises(ValueError):
        terms.term_frequencies(none, 32)
