"""Strict loading of delimited FASTQ and FASTA rows, and the reasons of those that fail.

Rows are loaded strictly first: only those that conform come out, typed. What
the strict load did not take is found by an anti-join on the row's offset
(``raw_id``, and a hash of the row, as offsets may repeat), and only this
remainder is diagnosed. All of it is built-in expressions; a row is cut into its
fields once, and possessive quantifiers keep the patterns linear, also on very
long rows.

Results for odd input: a null ``raw_text`` fails as ``quoting``; a null or
unknown ``kind`` has no right number of fields and fails as ``columns``; rows
with a null ``raw_id`` are diagnosed like all others; of rows with one ``raw_id``
each has its own fate; repeated rows come out as often as they came in; further
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.binding import let
from weftline.functions.sequences import clean_fasta_name, clean_seq

# One field, a whole row, and the columns by kind.
FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
ROW = rf"\A{FIELD}(?:,{FIELD})*+\z"
COLUMNS = {"fastq": ("ord", "name", "seq", "qual"), "fasta": ("ord", "name", "seq")}


def _row() -> Column:
    """The row without one CR at its end."""
    text = F.col("raw_text")
    return F.when(text.endswith("\r"), F.left(text, F.length(text) - 1)).otherwise(text)


def _quoted_well(row: Column) -> Column:
    return F.coalesce(~F.contains(row, F.lit('"')) | row.rlike(ROW), F.lit(False))


def _fields(row: Column) -> Column:
    """The fields of a well quoted row."""
    inner = lambda f: F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))
    # Each field is found with the comma before it, so that none is found without a symbol.
    found = F.regexp_extract_all(F.concat(F.lit(","), row), F.lit(rf"\G,({FIELD})"), 1)
    return F.when(~F.contains(row, F.lit('"')), F.split(row, ",", -1)).otherwise(F.transform(found, lambda f: F.when(f.startswith('"'), inner(f)).otherwise(f)))


def _valid(kind: str, f: dict[str, Column]) -> Column:
    """Whether the fields hold valid values."""
    ok = f["ord"].rlike(r"\A[0-9]{1,18}\z")
    if kind == "fastq":
        ok = ok & f["name"].rlike(r"\A@[!-~]++\z") & f["qual"].rlike(r"\A[!-~]*+\z")
        return ok & let(clean_seq(f["seq"]), lambda s: s.rlike(r"\A[ACGTN]++\z") & (F.length(f["qual"]) == F.length(s)))
    return ok & f["name"].rlike(r"\A>[ -~\t]*+\z") & (clean_fasta_name(f["name"]) != "") & clean_seq(f["seq"]).rlike(r"\A[ACGTN]++\z")


def _conforming(kind: str, fields: Column) -> Column:
    """The typed row in an array, which is empty for a row that does not conform."""
    names = COLUMNS[kind]
    f = {c: F.get(fields, F.lit(i)) for i, c in enumerate(names)}
    typed = F.struct(f["ord"].cast("bigint").alias("ord"), *(f[c].alias(c) for c in names[1:]))
    nothing = F.array().cast("array<struct<ord:bigint," + ",".join(f"{c}:string" for c in names[1:]) + ">>")
    return F.when((F.size(fields) == len(names)) & _valid(kind, f), F.array(typed)).otherwise(nothing)


def _loaded(kind: str, row: Column) -> Column:
    return let(_fields(row), lambda fields: _conforming(kind, fields))


def strict_load(raw: DataFrame, kind: str) -> DataFrame:
    """The conforming rows of one kind: ``raw_id, ord BIGINT, name, seq[, qual]``, names and sequences as delivered."""
    some = raw.where((F.col("kind") == kind) & _quoted_well(_row()))
    return some.select("raw_id", F.inline(_loaded(kind, _row())))


def failed_rows(raw: DataFrame) -> DataFrame:
    """``raw_id, reason`` of the rows that the strict load leaves out, by the first reason that applies."""
    row = _row()
    conforms = F.lit(False)
    for kind in COLUMNS:
        conforms = F.when(F.col("kind") == kind, F.size(_loaded(kind, row)) > 0).otherwise(conforms)
    offset = F.xxhash64("kind", "raw_text")
    loaded = raw.where(_quoted_well(row) & conforms).select(F.col("raw_id").alias("_id"), offset.alias("_g")).distinct()
    wanted = F.lit(-1)
    for kind, names in COLUMNS.items():
        wanted = F.when(F.col("kind") == kind, len(names)).otherwise(wanted)
    reason = F.when(~_quoted_well(row), "quoting").when(F.size(_fields(row)) != wanted, "columns").otherwise("value")
    # The texts stay where they are: the reason that holds if a row is not loaded travels instead.
    told = raw.select("raw_id", offset.alias("_h"), reason.alias("reason"))
    return told.join(loaded, F.col("raw_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g")), "left_anti").select("raw_id", "reason")
