import random

import pytest

from weftline.operators import exact

ALL = [*exact.STRATEGIES, "seed"]


def run(spark, texts, patterns, strategy):
    t = spark.createDataFrame(texts, "text_id bigint, text string, pos int")
    p = spark.createDataFrame(patterns, "pattern_id bigint, pattern string, text string")
    return sorted(tuple(r) for r in exact.exact_matches(t, p, strategy).select("text_id", "pattern_id", "pos").collect())


def naive(texts, patterns):
    return sorted(((t, p, i) for t, x, _ in texts if x is not None for p, w in {(p, w) for p, w, _ in patterns if w} for i in range(len(x) - len(w) + 1) if x[i : i + len(w)] == w), key=lambda r: (r[0] or 0, *r[1:]))


@pytest.mark.parametrize("strategy", ALL)
def test_goldens_and_random(spark, strategy):
    rng = random.Random(7)
    word = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    long_ = word("ab", 300)
    texts = [(1, "aaba", 0), (2, "abab", 0), (3, "aaaa", 0), (4, "", 0), (5, None, 0), (6, "né né", 0), (7, long_, 0)] + [(10 + i, word("abc", 99), 0) for i in range(10)]
    patterns = [(1, "a", "x"), (2, "ab", "x"), (3, "aa", "x"), (4, "", "x"), (5, None, "x"), (6, "né", "x"), (7, long_[100:140], "x"), (8, "é n", None), (1, "a", "x")]
    patterns += [(20 + i, t[1][: 5 + i], "p") for i, t in enumerate(texts[7:])] + [(40 + i, t[1][-5 - i :], "s") for i, t in enumerate(texts[7:])] + [(60 + i, word("abc", 5), "r") for i in range(10)]
    want = naive(texts, patterns)
    assert {(1, 1, 0), (1, 1, 1), (1, 1, 3), (2, 2, 0), (2, 2, 2), (3, 3, 0), (3, 3, 1), (3, 3, 2), (6, 6, 0), (6, 6, 3), (6, 8, 1)} <= set(want)
    assert run(spark, texts, patterns, strategy) == want


@pytest.mark.parametrize("strategy", ALL)
def test_nothing(spark, strategy):
    assert run(spark, [], [(1, "a", "")], strategy) == [] == run(spark, [(1, "a", 0)], [], strategy)


@pytest.mark.parametrize("strategy", [*exact.STRATEGIES])
def test_repeated_rows_and_null_ids(spark, strategy):
    got = run(spark, [(1, "ab", 0), (1, "ab", 0), (2, "b", 0)], [(1, "a", ""), (2, "b", "")], strategy)
    assert got == [(1, 1, 0), (1, 1, 0), (1, 2, 1), (1, 2, 1), (2, 2, 0)]


def test_many_patterns_by_scan(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    texts, patterns = [(i, word(200), 0) for i in range(5)], [(i, word(5) + "\\E'\""[: i % 4], "") for i in range(3000)]
    assert run(spark, texts, patterns, "scan") == naive(texts, patterns)


def test_seeds_pass_a_filter(spark):
    """A small filter lets more places pass and changes nothing."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    texts = [(i if i else None, word(rng.choice([5, 30, 500])), 0) for i in range(60)]
    patterns = [(i, texts[i][1][3:23], "") for i in range(60)]
    t = spark.createDataFrame(texts, "text_id bigint, text string, pos int")
    p = spark.createDataFrame(patterns, "pattern_id bigint, pattern string, text string")
    seeds = spark.createDataFrame([(5,), (69,), (64,)], "seed bigint")
    assert exact.seed_filter(seeds, 64).tolist() == [0b100001] and exact.seed_filter(seeds, 128).tolist() == [1 << 5, 0b100001]
    got = sorted(map(str, (tuple(r) for r in exact.by_seed(t.select("text_id", "text"), p, block=64).collect())))
    assert got == sorted(map(str, naive(texts, patterns)))


def test_patterns_with_one_beginning(spark):
    """Patterns long enough meet only where more than their common beginning stands."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    head = word(20)
    x = "".join(head + word(80) for _ in range(40))
    texts, patterns = [(1, x, 0), (2, head * 3, 0)], [(i, x[i * 100 : i * 100 + 64 + i], "") for i in range(40)] + [(50, head, ""), (51, head * 3, ""), (52, head * 4, "")]
    assert run(spark, texts, patterns, "seed") == naive(texts, patterns)
    t = spark.createDataFrame(texts[:1], "text_id bigint, text string, pos int").select("text_id", "text")
    seeds = spark.createDataFrame([(int(exact.far_hashes(exact.seed_hashes(p[:64], 16), 16).view("int64")[0]),) for _, p, _ in patterns[:40]], "seed bigint")
    shared = spark.sparkContext.broadcast(exact.seed_filter(seeds))
    assert t.mapInArrow(exact._seeds(16, 512, shared), "text_id bigint, block_no bigint, pos bigint, seed bigint").count() == 40


def test_seed_across_blocks(spark):
    rng = random.Random(3)
    x = "".join(rng.choice("acgt") for _ in range(3000))
    t = spark.createDataFrame([(1, x)], "text_id bigint, text string")
    p = spark.createDataFrame([(i, x[i * 40 : i * 40 + 90]) for i in range(70)], "pattern_id bigint, pattern string")
    got = sorted((r.pattern_id, r.pos) for r in exact.by_seed(t, p, block=128).collect())
    assert got == [(i, i * 40) for i in range(70)]


def test_borders(spark):
    def brute(p, i):
        return max(k for k in range(i) if p[:k] == p[i - k : i])

    rng = random.Random(5)
    words = ["", "a", "aaaa", "abab", "ababaca"] + ["".join(rng.choice("ab") for _ in range(12)) for _ in range(30)]
    for p in words:
        assert exact.borders(p) == [brute(p, i) for i in range(1, len(p) + 1)]
        for i, k in enumerate(exact.restricted_borders(p), 1):
            assert p[:k] == p[i - k : i] and (k == 0 or i == len(p) or p[k] != p[i])
    got = exact.border_arrays(spark.createDataFrame([(1, "aaba"), (2, None)], "pattern_id bigint, pattern string")).collect()
    assert {r.pattern_id: (r.borders, r.restricted) for r in got} == {1: ([0, 1, 0, 1], [0, 1, 0, 1]), 2: (None, None)}
