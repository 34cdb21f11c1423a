"""Token counts of whole texts by a public tokenizer, and ranks within groups of any size."""

from __future__ import annotations

import base64
import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrow import map_columns

#: Vocabulary file (ranks of a byte-level BPE), present on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How such a vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of one length that one task ranks at most, about.
RANK_ROWS = 200_000


@functools.lru_cache(maxsize=4)
def encoding(vocabulary: str = VOCABULARY, pattern: str = PATTERN):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _count(vocabulary: str):
    def make():
        enc = encoding(vocabulary)

        def f(ids: list, sources: list, texts: list) -> dict[str, list]:
            return {"id": ids, "source": sources, "tokens": [len(enc.encode_ordinary(t)) for t in texts]}

        return f

    return make


def token_counts(df: DataFrame, row_id: str, text: str, source: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, source, tokens) of every non-null text, counted in whole."""
    rows = df.select(F.col(row_id).cast("long").alias("id"), (F.col(source) if source else F.lit(None).cast("string")).alias("source"), F.col(text).alias("text"))
    return map_columns(rows.filter(F.col("text").isNotNull()), _count(vocabulary), "id long, source string, tokens long")


def small_rows(df: DataFrame, most: int) -> list:
    """Rows of a table that is small by contract; an error, not a cut, if it has more than `most`."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of at most {most} rows was expected")
    return rows


def ranked(df: DataFrame, group: list[str], order: Column, largest: int, rank: str = "rank") -> DataFrame:
    """Adds the 0-based rank of each row in its group, in the order of `order` (a hash, unique with the row's id).

    A group is cut into buckets by hash, so that no task gets more than about RANK_ROWS rows of the largest one; the
    buckets' sizes, summed up, give each bucket's first rank.
    """
    buckets = 1 + largest // RANK_ROWS
    d = df.withColumn("_o", order).withColumn("_b", F.pmod("_o", F.lit(buckets)))
    inner = Window.partitionBy(*group, "_b").orderBy("_o", "id", *(["piece"] if "piece" in df.columns else []))
    if buckets == 1:
        return d.withColumn(rank, (F.row_number().over(inner) - 1).cast("long")).drop("_o", "_b")
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = d.groupBy(*group, "_b").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return d.join(first, [*group, "_b"]).withColumn(rank, F.col("_first") + F.row_number().over(inner) - 1).drop("_o", "_b", "_first")
