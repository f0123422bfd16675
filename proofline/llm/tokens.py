"""Sizes of texts in tokens of a public tokenizer. The vocabulary file is a parameter; it is read on each worker."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's tokenizer cuts text before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=1)
def encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, keep: list[str], out: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` of ``df`` and the token count of its column ``text``; a null or empty text has 0 tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], "t"])

    inner = df.select(*[F.col(f"`{k}`").alias(f"c{i}") for i, k in enumerate(keep)], F.col(text).alias("t"))
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(inner.schema.fields[:-1])), "t bigint"])
    return inner.mapInArrow(count, schema).toDF(*keep, out)
