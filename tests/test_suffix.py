import random
import re

import numpy as np
import pyarrow as pa
import pytest

from weftline.operators import fm, suffix
from weftline.plans import ordinal
from weftline.plans.lineage import cut

MISS = "mississippi"


def texts(spark, rows):
    return spark.createDataFrame(rows, "text_id bigint, text string")


def words(spark, *ps):
    return spark.createDataFrame([*enumerate(ps)], "pattern_id bigint, pattern string")


def column(df, by, name):
    return [r[name] for r in df.orderBy(*by).collect()]


def brute(x):
    return sorted(range(len(x) + 1), key=lambda i: x[i:])


@pytest.fixture(scope="module")
def some():
    rng = random.Random(11)
    return [(1, MISS), (2, ""), (3, "a"), (4, "aaaaaaa"), (5, "né!ñ 𝄞a𝄞a")] + [(10 + i, "".join(rng.choice("acgt") for _ in range(49))) for i in range(10)] + [(30, "ab" * 40 + "a")]


def test_mississippi(spark):
    t = texts(spark, [(1, MISS)])
    assert column(suffix.suffix_array(t), ["rank"], "pos") == [11, 10, 7, 4, 1, 0, 9, 8, 6, 3, 5, 2]
    assert column(suffix.lcp_array(t), ["rank"], "lcp") == [0, 0, 1, 1, 4, 0, 0, 1, 0, 2, 1, 3]
    assert "".join("01"[b] for b in column(suffix.suffix_types(t), ["pos"], "s_type")) == "010010010001"
    assert column(suffix.lms_positions(t), ["pos"], "pos") == [1, 4, 7, 11]
    b = suffix.symbol_buckets(t).orderBy("code").collect()
    assert [r.n for r in b] == [1, 4, 1, 2, 4] and [r.bucket_beg for r in b] == [0, 1, 5, 6, 8] and [r.bucket_end for r in b] == [1, 5, 6, 8, 12]
    inner = {(r.depth, r.sa_lo, r.sa_hi) for r in suffix.tree(t).where("leaf_pos IS NULL").collect()}
    assert inner == {(0, 0, 12), (1, 1, 5), (1, 6, 8), (1, 8, 12), (2, 8, 10), (3, 10, 12), (4, 3, 5)}
    assert "".join(c or "$" for c in column(fm.bwt(t), ["rank"], "ch")) == "ipssm$pissii"
    assert "".join(c or "$" for c in column(fm.bwt_of_reverse(t), ["rank"], "ch")) == "ms$spipissii"
    assert column(fm.c_table(t), ["code"], "c") == [0, 1, 5, 6, 8]
    occ = fm.o_table(t).orderBy("rank").collect()
    assert [(r["rank"], r.occ) for r in occ if r.code == 1] == [(0, 1), (7, 2), (10, 3), (11, 4)]


def test_arrays_against_brute_force(spark, some):
    t = texts(spark, some + [(99, None)])
    rows = {}
    for r in suffix.suffix_index(t).collect():
        rows.setdefault(r.text_id, {})[r["rank"]] = r
    assert set(rows) == {i for i, _ in some}
    for i, x in some:
        sa = brute(x)
        got = [rows[i][k] for k in range(len(x) + 1)]
        assert [r.pos for r in got] == sa
        assert [r.ch for r in got] == [x[p - 1] if p else None for p in sa]
        syms = sorted(set(x))
        assert [r.code for r in got] == [syms.index(x[p - 1]) + 1 if p else 0 for p in sa]
        for a, b, r in zip(sa, sa[1:], got[1:]):
            k = 0
            while x[a + k : a + k + 1] and x[a + k : a + k + 1] == x[b + k : b + k + 1]:
                k += 1
            assert r.lcp == k
    back = {r.text_id: r.text for r in fm.inverse_bwt(fm.bwt(t)).collect()}
    assert back == dict(some)


def test_doubling_is_the_same(spark, some):
    t = texts(spark, [x for x in some if x[0] < 13])
    key = lambda df: sorted((r.text_id, r["rank"], r.pos) for r in df.collect())
    assert key(suffix.suffix_array(t, "doubling")) == key(suffix.suffix_array(t, "local"))


def test_doubling_on_repeated_rows(spark):
    t = texts(spark, [(1, "abab"), (1, "abab"), (None, "b"), (None, "b"), (2, "")])
    key = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    assert key(suffix.suffix_array(t, "doubling")) == key(suffix.suffix_array(t, "local"))


LONG = [(1, "ab" * 150), (1, "a" * 200), (2, "néñ𝄞" * 30 + "é"), (3, "acgt" * 40 + "acga" * 40), (None, "a" * 200), (4, "a\nb\n"), (5, ""), (6, None)]


def test_doubling_over_many_rounds(spark, monkeypatch):
    t = texts(spark, LONG).repartition(3)
    key = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    want = key(suffix.suffix_array(t, "local"))
    assert key(suffix.suffix_array(t, "doubling")) == want
    monkeypatch.setattr(suffix, "LOCAL", 150)
    assert key(suffix.suffix_array(t)) == want


def test_doubling_broadcasts_only_sizes_of_partitions(spark, monkeypatch):
    """Estimates follow the texts' files, which may be far smaller than their suffixes."""
    seen = []
    monkeypatch.setattr(suffix, "cut", lambda df: seen.append(df) or cut(df))
    monkeypatch.setattr(ordinal, "cut", lambda df: seen.append(df) or cut(df))
    seen.append(suffix.suffix_array_doubling(texts(spark, LONG)))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in seen]
    sent = [keys for plan in plans for keys in re.findall(r"BroadcastHashJoin \[(.*?)\]", plan)]
    assert len(plans) > 4 and all(keys.startswith("_p#") for keys in sent)


def test_estimates_do_not_grow_with_the_rounds(spark, monkeypatch):
    """The number of digits of an estimate must not double in every round."""
    sizes = []

    def seen(df):
        sizes.append(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return cut(df)

    monkeypatch.setattr(suffix, "cut", seen)
    assert suffix.suffix_array_doubling(texts(spark, [(1, "a" * 20_000)])).count() == 20_001
    assert len(sizes) > 6 and max(sizes) < 300


def test_packed_symbols(monkeypatch):
    monkeypatch.setattr(suffix, "ROWS", 7)
    held = ["", "a", MISS, "né!ñ 𝄞a𝄞a", "a\nb\0c\0", "ab" * 40 + "a"]
    own, start, pos, span, a, b = (np.concatenate(c).tolist() for c in zip(*suffix._packed(held)))
    assert [*zip(own, pos)] == [(i, p) for i, x in enumerate(held) for p in range(len(x) + 1)] and set(span) == {2 * (63 // 4)}
    assert [*map(sum, zip(start, pos))] == [*range(len(own))]
    first = [held[i][p : p + k] for i, p, k in zip(own, pos, span)]
    for i in range(len(held)):
        rows = sorted((x, y, w) for o, x, y, w in zip(own, a, b, first) if o == i)
        assert [w for _, _, w in rows] == sorted(w for _, _, w in rows) and len({r[:2] for r in rows}) == len({r[2] for r in rows})


def test_searches_agree(spark, some):
    t = texts(spark, some)
    ps = ["i", "missi", "", "zz", "a", "acg", "ssi", "𝄞a", "abab", "mississippi", "mississippix"]
    want = sorted((i, k, r, p) for i, x in some for k, w in enumerate(ps) for r, p in enumerate(brute(x)) if x[p:].startswith(w))
    for search in (suffix.sa_search, suffix.tree_search, fm.fm_search):
        got = sorted((r.text_id, r.pattern_id, r["rank"], r.pos) for r in search(t, words(spark, *ps)).collect())
        assert got == want, search
    assert [p for i, k, _, p in want if i == 1 and k == 0] == [10, 7, 4, 1]


def test_tree_search_joins_nothing(spark, some):
    t = texts(spark, [*some, (1, MISS), (3, "ba"), (None, "a"), (99, None)])
    found = suffix.tree_search(t, words(spark, "i", "a", "", "zz"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Repartition" not in plan
    key = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    assert key(found) == key(suffix.sa_search(t, words(spark, "i", "a", "", "zz")))


def test_leaves_in_small_batches(monkeypatch):
    monkeypatch.setattr(suffix, "ROWS", 2)
    schema = pa.schema([(c, pa.int64()) for c in ("text_id", "pattern_id", "rank", "pos")])
    parts = list(suffix._leaves([(7, 1, 4, np.array([3, 0, 5])), (None, 2, 0, np.array([9]))], schema))
    assert [x.num_rows for x in parts] == [2, 2]
    assert [tuple(r.values()) for x in parts for r in x.to_pylist()] == [(7, 1, 4, 3), (7, 1, 5, 0), (7, 1, 6, 5), (None, 2, 0, 9)]


def test_tree_shape(spark, some):
    for i, x in some:
        nodes = suffix.tree(texts(spark, [(i, x)])).orderBy("node_id").collect() if i in (1, 2, 4, 30) else []
        for r in nodes:
            if r.parent_id is not None:
                up = nodes[r.parent_id]
                assert up.sa_lo <= r.sa_lo and r.sa_hi <= up.sa_hi and r.edge_end - r.edge_beg == r.depth - up.depth > 0
        if nodes:
            assert sorted(r.leaf_pos for r in nodes if r.leaf_pos is not None) == [*range(len(x) + 1)]
            assert column(suffix.tree_leaves(texts(spark, [(i, x)])), ["rank"], "pos") == brute(x)


def test_locate(spark):
    got = {r.pattern_id: (r.matched, r.outcome) for r in suffix.tree_locate(texts(spark, [(1, MISS)]), words(spark, "i", "missi", "", "mx", "issx", "z", "miz")).collect()}
    assert got == {0: (1, "node match"), 1: (5, "edge match"), 2: (0, "node match"), 3: (1, "edge mismatch"), 4: (3, "edge mismatch"), 5: (0, "node mismatch"), 6: (2, "edge mismatch")}


def test_empty_tables(spark):
    t, p = texts(spark, []), words(spark, "a")
    none = spark.createDataFrame([], "pattern_id bigint, pattern string")
    for df in (suffix.suffix_array(t), suffix.suffix_array(t, "doubling"), suffix.tree(t), fm.fm_index(t), fm.inverse_bwt(fm.bwt(t)), suffix.sa_search(t, p), fm.fm_search(texts(spark, [(1, "a")]), none), suffix.tree_search(texts(spark, [(1, "a")]), none)):
        assert df.count() == 0
