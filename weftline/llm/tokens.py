"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the byte-level vocabularies cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoding(path: str):
    """The tokenizer of a file of ranks; special tokens are ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], path: str = TOKENIZER) -> list[int]:
    enc = encoding(path)
    return [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


def sized(docs: DataFrame, keep: list[str], text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the size of the whole text; null and empty texts have 0."""
    kept = docs.select(*keep, text)
    fields = [f for f in kept.schema if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", tokens bigint"
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array(count_tokens(batch.column(n).to_pylist(), path), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], sizes], names=[*keep, "tokens"])

    return kept.mapInArrow(run, schema)
