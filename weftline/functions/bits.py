"""Bit vectors: ``ARRAY<BOOLEAN>`` or a struct of ``no_bits`` and words of 64 bits.

Setting or reading a bit outside the vector gives an unchanged vector and null.
Null gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.binding import let
from weftline.functions.slices import Int, _c


def _upto(n: Column) -> Column:
    """0 .. n - 1, empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).when(n.isNotNull(), F.array().cast("array<int>"))


def zeros(n: Int) -> Column:
    words = F.array_repeat(F.lit(0).cast("bigint"), F.ceil(_c(n) / 64).cast("int"))
    return F.struct(_c(n).cast("bigint").alias("no_bits"), words.alias("words"))


def from_string(s: Column) -> Column:
    """True for each ``1``, false for any other symbol."""
    flags = F.when(F.length(s) > 0, F.transform(F.split(s, ""), lambda c: c == "1"))
    return F.when(s.isNotNull(), F.coalesce(flags, F.array().cast("array<boolean>")))


def pack(flags: Column) -> Column:
    """A boolean array as ``no_bits`` and words; bit i is bit i % 64 of word i div 64."""
    zero = F.lit(0).cast("bigint")
    bit = lambda b, i: F.when(b, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(zero)
    word = lambda f, w: F.aggregate(F.transform(F.slice(f, w * 64 + 1, F.lit(64)), bit), zero, lambda a, b: a.bitwiseOR(b))
    packed = lambda f: F.struct(F.size(f).cast("bigint").alias("no_bits"), F.transform(_upto(F.ceil(F.size(f) / 64)), lambda w: word(f, w)).alias("words"))
    return F.when(flags.isNotNull(), let(flags, packed))


def clear(v: Column) -> Column:
    return F.struct(v["no_bits"].alias("no_bits"), F.transform(v["words"], lambda _: F.lit(0).cast("bigint")).alias("words"))


def get(v: Column, i: Int) -> Column:
    i = _c(i)
    return F.when((i >= 0) & (i < v["no_bits"]), F.getbit(F.element_at(v["words"], (F.floor(i / 64) + 1).cast("int")), (i % 64).cast("int")) == 1)


def put(v: Column, i: Int, to: bool) -> Column:
    i = _c(i)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (i % 64).cast("int"))
    change = (lambda w: w.bitwiseOR(one)) if to else (lambda w: w.bitwiseAND(F.bitwise_not(one)))
    words = F.transform(v["words"], lambda w, k: F.when((F.floor(i / 64) == k) & (i >= 0) & (i < v["no_bits"]), change(w)).otherwise(w))
    return F.struct(v["no_bits"].alias("no_bits"), words.alias("words"))


def same(v: Column, w: Column) -> Column:
    return (v["no_bits"] == w["no_bits"]) & (v["words"] == w["words"])


def formatted(v: Column) -> Column:
    """``[0101...|...]``, a bar after each 64 bits."""
    bit = lambda w, i: F.getbit(w, i).cast("string")
    part = lambda w, k: F.array_join(F.transform(_upto(F.least(F.lit(64), v["no_bits"] - k * 64)), lambda i: bit(w, i)), "")
    return F.concat(F.lit("["), F.array_join(F.transform(v["words"], part), "|"), F.lit("]"))


def from_positions(df: DataFrame, key: str, pos: str, no_bits: str) -> DataFrame:
    """``key, no_bits, words`` from one row per set bit: words are combined before the shuffle. A key with a null position only has no bit set."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col(pos) % 64).cast("int"))
    word = df.groupBy(key, F.col(no_bits).alias("no_bits"), F.floor(F.col(pos) / 64).alias("w")).agg(F.bit_or(bit).alias("bits"))
    held = word.groupBy(key, "no_bits").agg(F.map_from_entries(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("w", "bits")))).alias("m"))
    words = F.transform(_upto(F.ceil(F.col("no_bits") / 64)), lambda k: F.coalesce(F.col("m")[k.cast("bigint")], F.lit(0).cast("bigint")))
    return held.select(key, F.col("no_bits").cast("bigint").alias("no_bits"), words.alias("words"))
