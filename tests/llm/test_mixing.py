import random

from weftline.llm import mixing

DOCS, TARGETS = "doc_id bigint, text string, source string, copies int, tokens int, rate double", "source string, target_share double, max_repeat int, tokens int"


def docs(spark, seed=1):
    rng = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 300))), s) for i, s in enumerate(["big"] * 300 + ["mid"] * 60 + ["small"] * 12 + ["none"] * 5 + [None] * 5)]
    rows += [(1000, None, "big"), (1001, "", "mid"), (None, "alpha", "mid"), (1002, "same", "small"), (1002, "same", "small")]
    return spark.createDataFrame([(*r, 7, 7, 0.5) for r in rows], DOCS)


def test_shares(spark):
    targets = spark.createDataFrame([("big", 0.5, 1, 0), ("mid", 0.3, 2, 0), ("small", 0.2, 4, 0), ("absent", 0.1, 1, 0), (None, 0.1, 1, 0), ("none", None, 1, 0), ("small", 0.1, 9, 0)], TARGETS)
    df = docs(spark)
    mix = mixing.mixed(df, targets)
    rows = mix.collect()
    assert len(rows) == df.count()
    assert all(r.copies == 0 for r in rows if r.source in (None, "none") or r.tokens == 0)
    report = {r.source: r for r in mixing.share_report(mix, targets).collect()}
    assert set(report) == {"big", "mid", "small", "absent"} and report["absent"].tokens == 0
    for s in ("big", "mid", "small"):
        assert abs(report[s].reached_share - report[s].target_share / 1.0) < 0.005, report[s]
        assert report[s].most_copies <= report[s].max_repeat
    # Small is used up, as the total is the largest at which all hold their shares.
    assert report["small"].most_copies == 4


def test_a_total_beyond_the_caps(spark):
    targets = spark.createDataFrame([("big", 0.5, 1, 0), ("small", 0.5, 2, 0)], TARGETS)
    report = {r.source: r for r in mixing.share_report(mixing.mixed(docs(spark), targets, total=10**6), targets).collect()}
    assert report["small"].most_copies == 2 and report["big"].most_copies == 1 and report["big"].reached_share > 0.5


def test_nothing(spark):
    df, targets = docs(spark), spark.createDataFrame([], TARGETS)
    assert mixing.mixed(df, targets).where("copies > 0").count() == 0
    some = spark.createDataFrame([("big", 1.0, None, 0)], TARGETS)
    assert mixing.mixed(df.limit(0), some).count() == 0
    assert mixing.share_report(mixing.mixed(df.limit(0), some), some).first().reached_share == 0
