"""Token counts of summaries, by a vocabulary file where one is given."""

from __future__ import annotations

import base64
import functools
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: How a byte-level vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str | None) -> Column:
    """Tokens of a whole text; null without a vocabulary, or where its file or the library isn't there, and for a null text."""

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        try:
            encode = _encoding(vocabulary).encode_ordinary if vocabulary and os.path.exists(vocabulary) else None
        except ImportError:
            encode = None
        return texts.map(lambda t: None if t is None or encode is None else len(encode(t))).astype("Int64")

    return count(text)
