import random

import pytest

from weftline.operators import approx, fm, index, suffix
from weftline.plans.lineage import stored

TEXTS = "text_id bigint, text string, sa string, pattern_id int"
PATTERNS = "pattern_id bigint, pattern string, text string"


def key(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(11)
    word = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    texts = [(1, "mississippi", "x", 0), (2, "", "x", 0), (3, None, "x", 0), (None, "né né", "x", 0), (1, "mississippi", "x", 0)] + [(10 + i, word("acgt", rng.randint(1, 60)), "x", 0) for i in range(40)]
    patterns = [(1, "issi", "x"), (2, "", "x"), (3, None, "x"), (4, "é", "x"), (5, "i", "x"), (5, "i", "x"), (6, "z", "x")] + [(10 + i, word("acgt", rng.randint(1, 6)), "x") for i in range(25)]
    return spark.createDataFrame(texts, TEXTS), spark.createDataFrame(patterns, PATTERNS)


def test_written_index_gives_the_rows_of_the_searches(spark, data):
    texts, patterns = data
    built = stored(index.build_index(texts))
    assert built.count() == 44
    want = key(suffix.sa_search(texts, patterns))
    assert len(want) > 500 and want == key(fm.fm_search(texts, patterns))
    for method in index.METHODS:
        assert key(index.search_index(built, patterns, method)) == want


@pytest.mark.parametrize("d", [0, 1, 2])
def test_alignments(spark, data, d):
    texts, patterns = data
    assert key(index.approx_index(index.build_index(texts), patterns, d)) == key(approx.approx_matches(texts, patterns, d))


def test_needed_edits_bound(spark):
    rng = random.Random(2)
    for _ in range(50):
        x, p = ("".join(rng.choice("acg") for _ in range(rng.randint(1, 30))) for _ in range(2))
        row = next(iter(index._build(set(index.ARRAYS))(iter([__import__("pyarrow").RecordBatch.from_pydict({"t": [1], "x": [x]})])))).to_pylist()[0]
        held = index.Held(row["text"], **{c: row[c] for c in index.ARRAYS})
        codes = held.codes(p)
        assert (codes is None) == (not set(p) <= set(x))
        if codes is not None:
            assert held.needed(codes) == approx.edits_needed(x, p)


def test_uses(spark, data):
    texts, patterns = data
    want = key(suffix.sa_search(texts, patterns))
    for use in index.METHODS:
        assert key(index.search_index(index.build_index(texts, use), patterns, use)) == want
    with pytest.raises(Exception, match="not built for this use"):
        index.search_index(index.build_index(texts, "sa"), patterns, "fm").count()


def test_nothing(spark, data):
    texts, patterns = data
    none = index.build_index(texts.limit(0))
    assert none.count() == index.search_index(none, patterns).count() == index.approx_index(none, patterns, 1).count() == 0
    assert index.search_index(index.build_index(texts), patterns.limit(0)).count() == 0
