"""Near-duplicate records with small edits (problem 7): deletion-variant signatures.

A text's distinct word shingles give a signature of N symbols (min-wise hashes, so two texts of similarity J agree in
each symbol with chance J). The signature is cut into N / SEGMENT segments, fewer than exact banding would need: if two
signatures differ in at most 2·segments − 1 symbols, some segment differs in at most one. So each segment is indexed
SEGMENT times, each time with another symbol as a wildcard, and an equality join on (segment, wildcard, the other
symbols) finds the pairs; each pair is then verified on the whole texts. A position is a symbol and not one bit,
because at a similarity of 0.7 one-bit positions would differ in 15 % of cases against 30 %, but match by chance half
the time: segments would have to be five times as long and four times as many.

Texts that are equal word by word are folded to one representative first, so copies, however many, meet once.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage
from .arrow import map_columns

SYMBOLS, SEGMENT = 40, 5
WORD_CACHE = 500_000


class _WordHashes(dict):
    """64-bit hash of each word, kept between texts up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(words: list[str], size: int, cache: _WordHashes) -> np.ndarray:
    """Distinct sequences of `size` successive words as sorted 64-bit hashes; none if there are fewer words."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    out = h[:n].copy()
    for k in range(1, size):
        out = _mixed(out) + h[k : k + n]
    return np.unique(_mixed(out))


_RNG = np.random.default_rng(20_240_607)
_MULTIPLIERS = (_RNG.integers(0, 2**63, SYMBOLS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Min-wise hash of a non-empty set under each of SYMBOLS multiplications."""
    low = np.full(SYMBOLS, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None] * _MULTIPLIERS[None, :]
        np.minimum(low, part.min(axis=0), out=low)
    return low


def variants(sig: np.ndarray) -> np.ndarray:
    """For each segment, and each symbol in it as the wildcard, one key over the other symbols."""
    seg = sig.reshape(-1, SEGMENT)
    mult = _RNG_KEYS[: seg.shape[0], :]
    each = _mixed(seg * mult)
    whole = each.sum(axis=1, dtype=np.uint64)
    salt = np.arange(1, seg.size + 1, dtype=np.uint64).reshape(seg.shape) * np.uint64(0xD6E8FEB86659FD93)
    return _mixed((whole[:, None] - each) + salt).ravel()


_RNG_KEYS = (_RNG.integers(0, 2**63, (SYMBOLS // SEGMENT, SEGMENT), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _sign(size: int):
    def make():
        cache = _WordHashes()

        def f(ids: list, texts: list) -> dict[str, list]:
            words_hash, keys = [], []
            for t in texts:
                words = t.lower().split()
                words_hash.append(xxhash.xxh3_128_digest("\x1f".join(words).encode("utf-8", "surrogatepass")))
                h = shingle_hashes(words, size, cache)
                keys.append(variants(signature(h)).view(np.int64) if len(h) else None)
            return {"id": ids, "same": words_hash, "keys": keys}

        return f

    return make


def _verify(size: int, threshold: float):
    def make():
        cache = _WordHashes()

        def f(left: list, right: list, texts_a: list, texts_b: list) -> dict[str, list]:
            known: dict[int, np.ndarray] = {}

            def of(i: int, t: str) -> np.ndarray:
                if i not in known:
                    if len(known) > 64:
                        known.clear()
                    known[i] = shingle_hashes(t.lower().split(), size, cache)
                return known[i]

            out = {"a": [], "b": [], "similarity": []}
            for i, j, t, u in zip(left, right, texts_a, texts_b):
                x, y = of(i, t), of(j, u)
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                s = both / (len(x) + len(y) - both)
                if s >= threshold - 1e-12:
                    for k, v in zip(out, (i, j, s)):
                        out[k].append(v)
            return out

        return f

    return make


def similar_texts(df: DataFrame, row_id: str, text: str, size: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(links, membership) of texts that share `threshold` of their distinct `size`-word shingles.

    links: a, b, similarity between representatives, a < b. membership: every row with a non-null text and its
    representative, the lowest id among the rows of the same words (lower-cased, split at white space).
    A text with fewer than `size` words has no shingles: it is linked with its equals only, through membership, as an empty
    one is. Null texts, null ids and an empty table give no rows; ids may repeat only with the same text. Other columns
    aren't read.
    """
    rows = df.select(F.col(row_id).alias("id"), F.col(text).alias("text")).dropna()
    signed = cut_lineage(map_columns(rows, _sign(size), "id long, same binary, keys array<long>"))
    reps = signed.groupBy("same").agg(F.min("id").alias("rep"))
    membership = signed.select("id", "same").join(reps, "same").select("id", "rep")
    keyed = signed.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").select("id", F.explode("keys").alias("k"))
    x, y = keyed.alias("x"), keyed.alias("y")
    pairs = cut_lineage(x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())
    # only texts that are in a pair move to it
    paired = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = cut_lineage(rows.join(paired, "id", "left_semi"))
    ta, tb = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb")
    links = map_columns(both, _verify(size, threshold), "a long, b long, similarity double")
    return links, membership


def row_pairs(links: DataFrame, membership: DataFrame) -> DataFrame:
    """All pairs of rows (a < b) that the links and the groups of equal texts stand for."""
    m = membership
    copies = m.alias("x").join(m.alias("y"), (F.col("x.rep") == F.col("y.rep")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    ma, mb = m.select(F.col("rep").alias("a"), F.col("id").alias("ia")), m.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    across = links.select("a", "b").join(ma, "a").join(mb, "b").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
    return copies.unionByName(across)


def found(spark, sf_dir: str) -> DataFrame:
    """p7_found: pairs of ingestion results whose contents share 70 % of their three-word shingles."""
    df = spark.read.parquet(f"{sf_dir}/ingestion_results.parquet")
    links, membership = similar_texts(df, "result_id", "content", size=3, threshold=0.7)
    return row_pairs(links, membership).select(F.col("a").alias("result_id_a"), F.col("b").alias("result_id_b"))
