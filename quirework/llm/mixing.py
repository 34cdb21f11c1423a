"""Mixing sources to target weights (problem 9): subset-sum budget fitting.

Documents are counted by exact token length in each source. A source's budget is met by whole repeats of all its documents
and, for what then remains, by as many documents of each length as a plan over the counts says: an even share of every
length first, long documents while the gap is wide, and at last a bounded-knapsack over the gap, which hits it exactly if
any choice of the documents left does. Which documents of a length are taken follows from a seeded hash.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.session import cut_lineage
from .tokens import VOCABULARY, ranked, small_rows, token_counts

#: Tokens that the knapsack spans; longer documents are chosen before it only.
GAP = 60_000
#: Rows that a table of targets may have; more is an error.
MAX_TARGETS = 10_000


def knapsack(counts: dict[int, int], target: int, seed: int = 0) -> dict[int, int]:
    """How many of each length to take so that the total comes as near to `target` from below as can be."""
    items: list[tuple[int, int]] = []
    # in order of length first, so that the seed alone decides, and not the order in which the counts were gathered
    for length, n in sorted(counts.items()):
        n, k = min(n, target // length if length else 0), 1
        while n > 0:
            items.append((length, min(k, n)))
            n -= k
            k *= 2
    random.Random(seed).shuffle(items)
    reach, steps, full = 1, [], (1 << (target + 1)) - 1
    for length, k in items:
        steps.append(reach)
        reach |= (reach << (length * k)) & full
        if reach >> target & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for (length, k), before in zip(reversed(items[: len(steps)]), reversed(steps)):
        if not before >> at & 1:
            at -= length * k
            out[length] = out.get(length, 0) + k
    return out


def choose(counts: dict[int, int], budget: int, seed: int = 0) -> dict[int, int]:
    """How many documents of each length to take for at most `budget` tokens, as near as can be."""
    total = sum(x * n for x, n in counts.items())
    if budget >= total:
        return dict(counts)
    share = max(0, budget - GAP) / total if total else 0
    take = {x: int(n * share) for x, n in counts.items()}
    gap = budget - sum(x * n for x, n in take.items())
    for x in sorted(counts, reverse=True):
        if gap > GAP and x:
            more = min(counts[x] - take[x], (gap - GAP // 2) // x if gap - GAP // 2 > 0 else 0)
            take[x] += more
            gap -= more * x
    if gap > GAP:  # only documents longer than the gap are left to fill it
        return take
    for x, n in knapsack({x: counts[x] - take[x] for x in counts if 0 < x <= gap and counts[x] > take[x]}, gap, seed).items():
        take[x] += n
    return take


def plan_mixture(counts: dict[str, dict[int, int]], targets: dict[str, tuple[float, int]], total: int | None = None, seed: int = 0) -> tuple[int, dict[str, tuple[int, dict[int, int]]]]:
    """(total tokens, by source: whole repeats and the documents of each length that come once more).

    Without a given total, the largest is taken that every source with documents can bear under its cap of repeats.
    """
    have = {s: sum(x * n for x, n in c.items()) for s, c in counts.items()}
    most = [have[s] * cap / w for s, (w, cap) in targets.items() if w > 0 and have.get(s)]
    size = int(min(most, default=0)) if total is None else total
    out = {}
    for s, (w, cap) in targets.items():
        if not have.get(s) or cap <= 0:
            continue
        budget = min(round(w * size), have[s] * cap)
        whole = budget // have[s]
        out[s] = (whole, choose(counts[s], budget - whole * have[s], seed) if whole < cap else {})
    return size, out


def mix(documents: DataFrame, targets: DataFrame, row_id: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY, total: int | None = None, seed: int = 11) -> DataFrame:
    """(id, source, tokens, repeats) of every record used in the mixture.

    `targets` (source, target_share, max_repeats) is a small table. Records of null or unlisted sources, null and empty texts
    aren't used; repeated texts are records of their own; a source without documents contributes nothing, and the others
    keep their size. An empty table gives no rows. More than MAX_TARGETS targets are an error.
    """
    want = {r[0]: (float(r[1]), int(r[2])) for r in small_rows(targets.select("source", "target_share", "max_repeats").dropna(), MAX_TARGETS)}
    listed = documents.filter(F.col(source).isin(list(want)))
    counted = cut_lineage(token_counts(listed, row_id, text, source, vocabulary).filter("tokens > 0"))
    # one row a source and length: bounded by the longest text, not by the number of documents
    histogram = counted.groupBy("source", "tokens").agg(F.count("*").alias("n")).collect()
    counts: dict[str, dict[int, int]] = {}
    for r in histogram:
        counts.setdefault(r["source"], {})[r["tokens"]] = r["n"]
    _, plan = plan_mixture(counts, want, total, seed)
    rows = [(s, x, whole, once.get(x, 0)) for s, (whole, once) in plan.items() for x in counts[s]]
    spark = documents.sparkSession
    slots = spark.createDataFrame(rows, "source string, tokens long, whole long, once long")
    order = ranked(counted, ["source", "tokens"], F.xxhash64(F.lit(seed), "id"), max((r["n"] for r in histogram), default=0))
    repeats = F.col("whole") + (F.col("rank") < F.col("once")).cast("long")
    return order.join(slots, ["source", "tokens"]).select("id", "source", "tokens", repeats.alias("repeats")).filter("repeats > 0")


def mixed(spark, sf_dir: str) -> DataFrame:
    """p9_mix: records of the mixture and how often each is used."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return mix(read("documents"), read("mix_targets")).withColumnRenamed("id", "doc_id")


def shares(spark, sf_dir: str) -> DataFrame:
    """p9_shares: the shares reached, against the targets."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    by = mixed(spark, sf_dir).groupBy("source").agg(F.count("*").alias("records"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("repeats"))
    # one row a source, so that a window over all of them is as small as the table of targets
    every = read("mix_targets").join(by, "source", "left").withColumn("total", F.sum("tokens").over(Window.partitionBy(F.lit(0))))
    return every.select("source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.col("total")).alias("share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("repeats", F.lit(0)).alias("most_repeats"), "max_repeats")
