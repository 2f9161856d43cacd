"""Slice functions on strings and arrays, with 0-based and negative positions.

A string is a sequence of code points. A position below 0 counts from the end.
Positions outside a value are cut to it for slices, and give null for one
symbol. Null in any argument gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Int = int | Column


def _c(v: Int) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _size(x: Column, array: bool) -> Column:
    return F.size(x) if array else F.length(x)


def _at(x: Column, i: Int, array: bool) -> Column:
    """The position from the start, cut to 0 .. length."""
    n = _size(x, array)
    i = _c(i)
    return F.least(n, F.greatest(F.lit(0), F.when(i < 0, n + i).otherwise(i)))


def symbol_at(x: Column, i: Int, array: bool = False) -> Column:
    n = _size(x, array)
    i = _c(i)
    j = F.when(i < 0, n + i).otherwise(i)
    one = F.try_element_at(x, j + 1) if array else F.substring(x, j + 1, F.lit(1))
    return F.when((j >= 0) & (j < n), one)


def subslice(x: Column, i: Int, j: Int, array: bool = False) -> Column:
    """Symbols ``i`` to before ``j``; empty where ``j`` is not after ``i``."""
    a, b = _at(x, i, array), _at(x, j, array)
    size = F.greatest(F.lit(0), b - a)
    return F.slice(x, a + 1, size) if array else F.substring(x, a + 1, size)


def prefix(x: Column, i: Int, array: bool = False) -> Column:
    return subslice(x, 0, i, array)


def suffix(x: Column, i: Int, array: bool = False) -> Column:
    return subslice(x, i, _size(x, array), array)


def reverse(x: Column) -> Column:
    return F.reverse(x)


def same(x: Column, y: Column) -> Column:
    return x == y


def at_most(x: Column, y: Column) -> Column:
    """Lexicographic; a proper prefix is smaller."""
    return x <= y


def at_least(x: Column, y: Column) -> Column:
    return x >= y


def common_prefix(x: Column, y: Column, array: bool = False) -> Column:
    """The length of the longest common prefix, without rescanning for each position."""
    a, b = (x, y) if array else (F.split(x, ""), F.split(y, ""))
    n = F.least(_size(x, array), _size(y, array))
    pairs = F.arrays_zip(F.slice(a, F.lit(1), n).alias("l"), F.slice(b, F.lit(1), n).alias("r"))
    differs = F.array_position(F.transform(pairs, lambda p: p["l"] == p["r"]), F.lit(False))
    return F.when(n == 0, F.lit(0).cast("bigint")).otherwise(F.when(differs == 0, n.cast("bigint")).otherwise(differs - 1))


def formatted(x: Column, array: bool = False) -> Column:
    """``[a, b, c]``."""
    items = x.cast("array<string>") if array else F.when(F.length(x) > 0, F.split(x, "")).otherwise(F.array().cast("array<string>"))
    return F.when(x.isNotNull(), F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")))


def append(x: Column, more: Column) -> Column:
    return F.concat(x, more)


def append_at(x: Column, to: Int, more: Column, array: bool = False) -> Column:
    """Cut to the first ``to`` symbols, then append."""
    return F.concat(prefix(x, to, array), more)
