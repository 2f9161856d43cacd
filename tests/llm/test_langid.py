import os
import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import langid

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, segments string, label string, _h bigint"


def test_labels():
    same = {"en": "EN  eng English en-GB", "de": "deu ger German de_AT", "sv": " sv swe SWEDISH", "nl": "nld dut Dutch nl-BE"}
    assert all(langid.label_code(x) == k for k, v in same.items() for x in v.split())
    assert [langid.label_code(x) for x in (None, "", " ", "??", "und", "mul", "xx", "fr,nl", "eng lish")] == [None] * 9


def test_a_language_of_the_samples_only(spark):
    """Languages come from the samples, also those without a list of names."""
    rng = random.Random(2)
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(2, 7)))
    text = lambda a, n: " ".join(word(a) for _ in range(n))
    samples = spark.createDataFrame([(i, k, text(a, 60)) for i in range(12) for k, a in (("fi", "aeiklnstuyä"), ("pl", "acdjkowzżłś"))], "sample_id bigint, lang string, text string")
    page = lambda a: "\n".join(text(a, 8) for _ in range(5))
    df = spark.createDataFrame([(1, page("aeiklnstuyä"), "fi-FI", "", "", 0), (2, page("acdjkowzżłś"), "fi", "", "", 0), (3, page("acdjkowzżłś"), "en", "", "", 0)], DOCS)
    assert sorted(map(tuple, langid.relabelled(df, samples).collect())) == [(2, 0, "pl"), (3, 0, "pl")]


def test_automaton_accepts_exactly_the_substrings():
    rng = random.Random(1)
    for _ in range(30):
        text = [rng.randint(0, 2) for _ in range(rng.randint(0, 14))]
        step = langid.suffix_automaton(text)
        subs = {tuple(text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1)}
        seen, todo = set(), [((), 0)]
        while todo:
            word, state = todo.pop()
            seen.add(word)
            todo += [((*word, c), to) for c, to in step[state].items()]
        assert seen == subs


def phrases(line, sample):
    """Phrases of a line by plain search, behind a blank as the parser has it."""
    x, n, at = line, 1, ""
    for c in x:
        if at + c in sample:
            at += c
        else:
            n, at = n + 1, c if c in sample else ""
    return n


def test_phrases_against_search():
    samples = {"de": "der hund lief in den wald", "en": "the dog ran into the wood"}
    p = langid.Parser(samples)
    bits, letters, per_text = p.lines(["the dog\n\n den  Wald 12", "", "ÿq"])
    assert per_text.tolist() == [3, 1, 1] and letters.tolist() == [6, 0, 7, 0, 2]
    for i, line in ((0, "the dog "), (2, "den wald ")):
        for j, lang in enumerate(p.langs):
            assert round(float(bits[i, j] / p.bits[j])) == phrases(" " + line, f" {samples[lang]} ")
    assert (bits[[1, 3]] == 0).all()


def reference(cost, pull):
    """The cheapest course by trying all."""
    import itertools

    import numpy as np

    n, k = cost.shape
    best = None
    for course in itertools.product(range(k), repeat=n):
        runs = [len([*g]) for _, g in itertools.groupby(course)]
        if min(runs) < min(3, n):
            continue
        c = sum(cost[i, x] for i, x in enumerate(course)) + sum(1.2 - 0.01 * pull[i] for i in range(1, n) if course[i] != course[i - 1])
        best = c if best is None else min(best, c)
    return best, np


def test_segments_against_all_courses():
    rng = random.Random(4)
    for _ in range(60):
        sizes = [rng.randint(1, 8) for _ in range(3)]
        n = sum(sizes)
        import numpy as np

        cost = np.array([[rng.choice([0, 0, 0.4, 1]) for _ in range(3)] for _ in range(n)], np.float32)
        pull = np.array([rng.choice([-1, 0, 1]) for _ in range(n)])
        got = langid.segment(cost, pull, np.array(sizes))
        at = 0
        for s in sizes:
            c, p, g = cost[at : at + s], pull[at : at + s], got[at : at + s]
            total = sum(c[i, x] for i, x in enumerate(g)) + sum(1.2 - 0.01 * p[i] for i in range(1, s) if g[i] != g[i - 1])
            assert total == pytest.approx(reference(c, p)[0], abs=1e-4)
            at += s


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_samples(spark):
    """Held-out accuracy: fitted on three quarters of the samples, every other one is judged."""
    samples = spark.read.parquet(f"{DATA}/lang_samples.parquet")
    held = samples.where("sample_id % 4 = 0")
    docs = held.select(F.col("sample_id").alias("doc_id"), F.regexp_replace("text", r"(.{30,50}) ", "$1\n").alias("text"), F.lit(None).cast("string").alias("lang"), F.col("lang").alias("right"))
    got = {r.doc_id: r for r in langid.languages(docs, samples.where("sample_id % 4 <> 0")).collect()}
    right = {r.doc_id: r.right for r in docs.collect()}
    assert sum(got[i].lang == right[i] for i in right) >= 0.98 * len(right)
    assert all(0 < r.confidence <= 1 for r in got.values())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_cases(spark):
    samples = spark.read.parquet(f"{DATA}/lang_samples.parquet")
    text = {}
    for r in samples.orderBy("sample_id").collect():
        text.setdefault(r.lang, []).append(r.text)
    lines = lambda k, n: "\n".join(text[k][:n])
    head = "HARROWMERE COURIER Saturday 13 October 1896"
    rows = [
        (1, lines("en", 5), "English"), (2, lines("en", 5), "de"), (3, lines("en", 5), None), (4, lines("en", 4) + "\n" + lines("fr", 4), "en"),
        (5, lines("en", 4) + "\n" + lines("fr", 2) + "\n" + lines("en", 4), "en-GB"), (6, None, None), (7, "", "xx"), (8, "12 345\n6,7", "??"), (9, lines("sv", 1), "sv"), (9, lines("sv", 1), "sv"),
        (None, lines("it", 3), ""), (10, lines("de", 4) + "\n" + head + "\n" + lines("nl", 5), "de"), (11, lines("pt", 8) + "\n" + "x " * 40_000, "pt"),
    ]
    df = spark.createDataFrame([(*r, "s", "l", 0) for r in rows], DOCS)
    got = sorted(map(tuple, langid.relabelled(df, samples).collect()), key=str)
    want = [(2, 0, "en"), (3, 0, "en"), (4, 0, "en"), (4, 4, "fr"), (None, 0, "it"), (10, 0, "de"), (10, 4, "nl")]
    assert got == sorted(want, key=str)
    assert langid.relabelled(df.limit(0), samples).count() == 0
    with pytest.raises(ValueError):
        langid.judged(df, samples.limit(0))
