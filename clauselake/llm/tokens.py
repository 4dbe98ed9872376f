"""Token counts by a public tokenizer file, read on the workers; the file's path is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
_encoders: dict[tuple[str, str], object] = {}


def encoder(path: str | None = None, pattern: str | None = None):
    """Encoding of a .tiktoken file with its split pattern, kept by the worker; what is not given comes from the installed vocabulary package."""
    import tiktoken

    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    if (path, pattern) not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path, pattern] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


def with_tokens(df: DataFrame, text_col: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with a column n_tokens in place of the text; null and empty texts have 0 tokens."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path, pattern).encode_ordinary
        for s in batches:
            yield s.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return df.withColumn("n_tokens", count(F.col(text_col))).drop(text_col)
