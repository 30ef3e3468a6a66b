"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank file and split pattern; every node must be able to read the file.
RANKS = os.environ.get("DOCKETRY_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the public pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = RANKS) -> Column:
    """Number of tokens of the whole text; 0 for null and empty texts."""

    @F.pandas_udf("long")
    def count(texts):
        enc = encoding(path)
        return texts.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int64")

    return count(text)


def document_sizes(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, source, n_tokens) of all documents."""
    return docs.select("doc_id", "source", token_count(F.col("text"), path).alias("n_tokens"))
