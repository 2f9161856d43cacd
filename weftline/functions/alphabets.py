"""Alphabets: the distinct symbols of a text in order of code point, with dense codes.

Code 0 is the sentinel that ends every text and is never stored; the symbols
have codes from 1. A null text has a null alphabet, an empty one an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _chars(x: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.when(F.length(x) > 0, F.split(x, "")).when(x.isNotNull(), empty)


def symbols_of(x: Column) -> Column:
    return F.array_sort(F.array_distinct(_chars(x)))


def mapped(x: Column, syms: Column) -> Column:
    """The codes of a text; null if any symbol is not in the alphabet."""
    codes = F.transform(_chars(x), lambda c: F.array_position(syms, c))
    return F.when(~F.exists(codes, lambda k: k == 0), codes)


def unmapped(codes: Column, syms: Column) -> Column:
    """The text of codes; null if any code is not in the alphabet."""
    known = F.forall(codes, lambda k: (k >= 1) & (k <= F.size(syms)))
    return F.when(known, F.array_join(F.transform(codes, lambda k: F.try_element_at(syms, k.cast("int"))), ""))


def alphabet(texts: DataFrame) -> DataFrame:
    """``text_id, sym, code`` of ``texts(text_id, text)``, row by row without a shuffle."""
    return texts.select("text_id", F.posexplode(symbols_of(F.col("text"))).alias("i", "sym")).select("text_id", "sym", (F.col("i") + 1).alias("code"))
