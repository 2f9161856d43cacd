"""Cleaning of sequences and record names, as column expressions and on Python strings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"
DROP = dict.fromkeys(map(ord, BLANKS))


def clean_seq(c: Column) -> Column:
    """The sequence without white space, in upper case; null stays null."""
    return F.upper(F.translate(c, BLANKS, ""))


def clean(seq: str) -> str:
    return seq.translate(DROP).upper()


def clean_fasta_name(c: Column) -> Column:
    """The name without any ``>``, blank or tab."""
    return F.translate(c, "> \t", "")


def clean_fastq_name(c: Column) -> Column:
    """The name up to the first blank, tab or slash, without a leading ``@``."""
    return F.regexp_extract(c, r"\A@?([^ \t/]*)", 1)


def symbols(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
