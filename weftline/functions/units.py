"""Bytes as the unit of a text.

Operators count code points. A text whose bytes are to be counted is mapped to
one symbol for each byte (U+0000 to U+00FF), which keeps its order; every operator
then gives byte positions. Null stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SINGLE = "ISO-8859-1"


def bytes_as_symbols(c: Column, binary: bool = False) -> Column:
    """One symbol for each byte of a string in UTF-8, or of a ``BINARY`` value."""
    return F.decode(c if binary else F.encode(c, "UTF-8"), SINGLE)


def symbols_as_bytes(c: Column) -> Column:
    """The ``BINARY`` value that ``bytes_as_symbols`` came from."""
    return F.encode(c, SINGLE)


def by_bytes(df: DataFrame, column: str) -> DataFrame:
    """A table of texts or patterns with the column (a string or ``BINARY``) in bytes."""
    binary = dict(df.dtypes)[column] == "binary"
    return df.withColumn(column, bytes_as_symbols(F.col(column), binary))
