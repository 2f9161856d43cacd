import random
from itertools import product

from pyspark.sql import functions as F

from weftline.operators import approx


def brute(x, p, d):
    """All edit strings, applied from every end."""
    out = set()
    if not set(p) <= set(x):
        return out
    for size in range(len(p), len(p) + d + 1):
        for e in product("MID", repeat=size):
            if sum(c != "D" for c in e) != len(p) or (e and "D" in (e[0], e[-1])) or sum(c != "M" for c in e) > d:
                continue
            for end in range(len(x) + 1):
                i, j, cost = len(p), end, 0
                for c in e:
                    if c != "I" and j == 0:
                        break
                    if c == "M":
                        cost += p[i - 1] != x[j - 1]
                    else:
                        cost += 1
                    i -= c != "D"
                    j -= c != "I"
                else:
                    if cost <= d:
                        out.add((j, "".join(e), cost))
    return out


def test_golden():
    want = {(5, "3M"), (2, "3M"), (6, "2M1I"), (3, "2M1I"), (6, "1M1I1M"), (3, "1M1I1M"), (5, "1I2M"), (2, "1I2M")}
    got = [(j, approx.run_lengths(e)) for j, e, _ in approx.alignments("mississippi", "ssi", 1)]
    assert set(got) == want and len(got) == len(want)


def test_against_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        x = "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))
        p = "".join(rng.choice("abc"[: 2 + (rng.random() < 0.1)]) for _ in range(rng.randint(0, 5)))
        for d in (0, 1, 2):
            got = [*approx.alignments(x, p, d)]
            assert set(got) == brute(x, p, d) and len(set(got)) == len(got), (x, p, d)


def test_rows(spark):
    texts = spark.createDataFrame([(1, "mississippi", 0), (2, None, 0), (3, "", 0), (1, "mississippi", 1)], "text_id bigint, text string, dist int")
    patterns = spark.createDataFrame([(1, "ssi"), (2, None), (3, ""), (4, "zz")], "pattern_id bigint, pattern string")
    rows = approx.approx_matches(texts, patterns, 1)
    got = rows.where("pattern_id = 1").collect()
    assert len(got) == 16 and all(r.cigar_fwd == approx.run_lengths(r.edits[::-1]) for r in got)
    assert rows.where("pattern_id = 3").count() == 2 * 12 + 1 and rows.where("pattern_id in (2, 4)").count() == 0
    assert rows.where(approx.cigar(F.col("edits")) != F.col("cigar")).count() == 0
    best = {(r.text_id, r.pattern_id): (r.dist, r.n) for r in approx.best_matches(texts.limit(1), patterns, 1).collect()}
    assert best[1, 1] == (0, 2)


def test_needed_edits(spark):
    assert approx.edits_needed("mississippi", "ssixpps") == [0, 0, 0, 1, 1, 1, 2]
    t = spark.createDataFrame([(1, "ab")], "text_id bigint, text string")
    p = spark.createDataFrame([(1, "ba"), (2, "")], "pattern_id bigint, pattern string")
    assert {r.pattern_id: r.needed for r in approx.needed_edits(t, p).collect()} == {1: [0, 1], 2: []}


def test_seed_strategy_gives_the_same(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    texts = [(i if i else None, word(rng.choice([0, 40, 300, 5000]))) for i in range(12)] + [(50, None), (51, "")]
    patterns = [(99, None), (98, ""), (97, "AC"), (96, "N" * 40)]
    for i, (_, x) in enumerate(texts[:12]):
        for k in range(3):
            at = rng.randint(0, max(0, len(x) - 90))
            p = list(x[at : at + rng.randint(30, 90)])
            for _ in range(rng.randint(0, 3)):
                if p:
                    j = rng.randrange(len(p))
                    p[j : j + 1] = rng.choice([[], [rng.choice("ACGT")], [p[j], "A"]])
            patterns.append((3 * i + k, "".join(p)))
    t = spark.createDataFrame(texts, "text_id bigint, text string")
    p = spark.createDataFrame(patterns, "pattern_id bigint, pattern string")
    for d in (0, 1, 2):
        some = p if d < 2 else p.where("pattern <> 'AC'")
        got = sorted(map(str, (tuple(r) for r in approx.approx_matches(t, some, d, "seed").collect())))
        want = sorted(map(str, (tuple(r) for r in approx.approx_matches(t, some, d).collect())))
        assert got == want and len(got) > 20
    assert approx.approx_matches(t.limit(0), p, 1, "seed").count() == approx.approx_matches(t, p.limit(0), 1, "seed").count() == 0
