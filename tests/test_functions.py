import random

from pyspark.sql import functions as F

from weftline.functions import alphabets, bits, slices, units
from weftline.operators import exact


def one(spark, text, **columns):
    df = spark.createDataFrame([(text,)], "x string")
    return df.select(*(c.alias(k) for k, c in columns.items())).first()


def test_slices_of_foobarbaz(spark):
    x = F.col("x")
    r = one(
        spark, "foobarbaz",
        a=slices.subslice(x, 3, 6), b=slices.subslice(x, -6, -3), c=slices.prefix(x, 3), d=slices.prefix(x, -3), e=slices.prefix(x, 0), f=slices.prefix(x, -9),
        g=slices.suffix(x, 3), h=slices.suffix(x, -3), i=slices.suffix(x, 9), j=slices.symbol_at(x, 0), k=slices.symbol_at(x, -1), l=slices.symbol_at(x, 9), m=slices.subslice(x, 5, 2), n=slices.symbol_at(x, -10),
    )
    assert tuple(r) == ("bar", "bar", "foo", "foobar", "", "", "barbaz", "baz", "", "f", "z", None, "", None)


def test_slices_against_python(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("abé") for _ in range(rng.randint(0, 6))), rng.randint(-8, 8), rng.randint(-8, 8)) for _ in range(200)]
    df = spark.createDataFrame(rows, "x string, i int, j int")
    codes = F.when(F.length("x") > 0, F.split("x", "")).otherwise(F.array().cast("array<string>"))
    got = df.select("x", "i", "j", slices.subslice(F.col("x"), F.col("i"), F.col("j")).alias("s"), slices.subslice(codes, F.col("i"), F.col("j"), True).alias("a")).collect()
    for r in got:
        assert r.s == r.x[r.i : r.j] == "".join(r.a), r


def test_lcp_and_order(spark):
    pairs = [("foobar", "foobar", 6), ("foobar", "foo", 3), ("foobar", "foobaz", 5), ("", "a", 0), ("", "", 0), ("b", "a", 0)]
    df = spark.createDataFrame([p[:2] for p in pairs], "x string, y string")
    x, y = F.col("x"), F.col("y")
    got = df.select("x", "y", slices.common_prefix(x, y).alias("n"), slices.same(x, y).alias("eq"), slices.at_most(x, y).alias("le"), slices.at_least(x, y).alias("ge")).collect()
    assert [r.n for r in got] == [p[2] for p in pairs]
    assert all((r.eq, r.le, r.ge) == (r.x == r.y, r.x <= r.y, r.x >= r.y) for r in got)


def test_null_slices(spark):
    x = F.col("x")
    assert tuple(one(spark, None, a=slices.subslice(x, 0, 1), b=slices.common_prefix(x, x), c=slices.formatted(x), d=bits.from_string(x), e=alphabets.mapped(x, alphabets.symbols_of(x)))) == (None,) * 5


def test_format_and_append(spark):
    x = F.col("x")
    r = one(spark, "abc", a=slices.formatted(x), b=slices.append(x, F.lit("d")), c=slices.append_at(x, 1, F.lit("z")), d=slices.formatted(F.array(F.lit(1), F.lit(-2)), True))
    assert tuple(r) == ("[a, b, c]", "abcd", "az", "[1, -2]")
    assert one(spark, "", a=slices.formatted(x)).a == "[]"


def test_alphabet_of_foobar(spark):
    texts = spark.createDataFrame([(1, "foobar"), (2, ""), (3, None)], "text_id bigint, text string")
    got = {(r.sym, r.code) for r in alphabets.alphabet(texts).collect()}
    assert got == {("a", 1), ("b", 2), ("f", 3), ("o", 4), ("r", 5)}
    syms = alphabets.symbols_of(F.col("x"))
    r = one(spark, "foobar", codes=alphabets.mapped(F.col("x"), syms), none=alphabets.mapped(F.lit("qux"), syms), back=alphabets.unmapped(alphabets.mapped(F.col("x"), syms), syms), bad=alphabets.unmapped(F.array(F.lit(9).cast("bigint")), syms))
    assert r.codes == [3, 4, 4, 2, 1, 5] and r.none is None and r.back == "foobar" and r.bad is None


def test_bit_vectors(spark):
    x = F.col("x")
    v = bits.pack(bits.from_string(x))
    for n, words in ((63, 1), (64, 1), (65, 2), (0, 0)):
        r = one(spark, "0" * n, v=v, z=bits.zeros(n), s=bits.formatted(v))
        assert len(r.v.words) == words == len(r.z.words)
    r = one(spark, "001001", v=v, a=bits.get(v, 2), b=bits.get(v, 3), c=bits.get(v, 6), s=bits.formatted(v))
    assert r.v.words == [36] and (r.a, r.b, r.c, r.s) == (True, False, None, "[001001]")
    text = "10" * 65
    r = one(spark, text, s=bits.formatted(v), t=bits.formatted(bits.put(bits.put(v, 1, True), 0, False)), u=bits.formatted(bits.put(v, 500, True)), c=bits.formatted(bits.clear(v)), e=bits.same(v, v), f=bits.same(v, bits.put(v, 129, True)))
    shown = "[" + text[:64] + "|" + text[64:128] + "|" + text[128:] + "]"
    assert r.s == shown == r.u and r.t == shown.replace("[10", "[01", 1) and r.c == shown.replace("1", "0") and r.e and not r.f


def test_bits_from_positions(spark):
    df = spark.createDataFrame([(1, 0, 70), (1, 63, 70), (1, 64, 70), (1, None, 70), (2, 5, 6), (3, None, 65), (4, None, 0)], "k int, pos bigint, n bigint")
    got = {r.k: (r.no_bits, r.words) for r in bits.from_positions(df, "k", "pos", "n").collect()}
    assert got == {1: (70, [1 - (1 << 63), 1]), 2: (6, [32]), 3: (65, [0, 0]), 4: (0, [])}


def test_bytes(spark):
    df = spark.createDataFrame([(1, "né né", bytearray(b"\x00\xffA")), (2, None, None), (3, "", bytearray(b""))], "text_id bigint, text string, raw binary")
    p = spark.createDataFrame([(1, "n"), (2, "é")], "pattern_id bigint, pattern string")
    got = sorted(tuple(r) for r in exact.exact_matches(units.by_bytes(df, "text"), units.by_bytes(p, "pattern")).collect())
    assert got == [(1, 1, 0), (1, 1, 4), (1, 2, 1), (1, 2, 5)]
    back = units.by_bytes(df, "raw").select("text_id", F.length("raw").alias("n"), units.symbols_as_bytes(F.col("raw")).alias("raw")).orderBy("text_id").collect()
    assert [(r.n, r.raw) for r in back] == [(3, bytearray(b"\x00\xffA")), (None, None), (0, bytearray(b""))]
