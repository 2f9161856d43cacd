"""A stated set of patterns in blocks of bounded size, each sent to all workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame

BLOCK_SYMBOLS = 1 << 22


def pattern_blocks(patterns: DataFrame, symbols: int = BLOCK_SYMBOLS) -> Iterator[list[tuple[int, str]]]:
    """Distinct ``(pattern_id, pattern)`` in blocks; the driver holds one block at a time. Null patterns are left out."""
    block, size = [], 0
    for r in patterns.select("pattern_id", "pattern").where("pattern IS NOT NULL").distinct().toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1]) + 16
        if size >= symbols:
            yield block
            block, size = [], 0
    if block:
        yield block


def over_blocks(texts: DataFrame, patterns: DataFrame, one: Callable[[DataFrame, list[tuple[int, str]]], DataFrame]) -> DataFrame:
    """The union of an operator's rows over all blocks; with no pattern, its rows for an empty block."""
    parts = [one(texts, block) for block in pattern_blocks(patterns)] or [one(texts, [])]
    return reduce(DataFrame.union, parts)
