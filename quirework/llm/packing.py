"""Filling fixed-capacity containers with items (problem 8): length-histogram planning.

The plan is made over counts: how many pieces there are of each length. Lengths don't exceed the capacity, since longer
texts are cut into full pieces and a rest, so the histogram and the plan are bounded by the capacity, whatever the number
of documents. Best fit, longest first, is done for all pieces of a length at once: groups of containers with the same room
take them together. Then each document's rank within its length looks up its slot.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage
from .arrow import map_columns
from .tokens import VOCABULARY, ranked, small_rows, token_counts

#: Kinds of containers that a table of limits may have; more is an error.
MAX_KINDS = 1000


def plan_slots(counts: dict[int, int], capacity: int) -> tuple[dict[int, tuple[list[int], list[int]]], int]:
    """By length the ranks at which a run of slots begins and the container of each run's first slot; and how many containers.

    Ranks from the k-th to the next run's first go to successive containers.
    """
    room: list[int] = []  # remaining rooms that occur, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> runs of containers (first, how many)
    used = 0
    plan: dict[int, tuple[list[int], list[int]]] = {}

    def give(r: int, first: int, n: int) -> None:
        if r not in groups:
            groups[r] = []
            bisect.insort(room, r)
        groups[r].append((first, n))

    for length in sorted((x for x in counts if 0 < x <= capacity), reverse=True):
        left, at = counts[length], 0
        runs, firsts = plan.setdefault(length, ([], []))
        while left:
            k = bisect.bisect_left(room, length)
            if k == len(room):
                # as many new containers as the pieces fill, all alike
                each = capacity // length
                fresh = max(1, left // each)
                give(capacity, used, fresh)
                used += fresh
                continue
            r = room[k]
            first, n = groups[r].pop()
            if not groups[r]:
                del groups[r]
                room.pop(k)
            take = min(n, left)
            runs.append(at)
            firsts.append(first)
            at += take
            left -= take
            if take < n:
                give(r, first + take, n - take)
            if r > length:
                give(r - length, first, take)
    return plan, used


def _place(plans: dict[str, dict[int, tuple[list[int], list[int]]]]):
    """Looks the slots up; plans are bounded by the capacities and sent with the task."""
    flat = {(kind, length): (np.array(a), np.array(b)) for kind, p in plans.items() for length, (a, b) in p.items()}

    def make():
        def f(kinds: list, ids: list, pieces: list, begins: list, lengths: list, ranks: list) -> dict[str, list]:
            out = np.empty(len(ids), np.int64)
            where: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(kinds, lengths)):
                where.setdefault(key, []).append(k)
            r = np.array(ranks, np.int64)
            for key, at in where.items():
                runs, firsts = flat[key]
                run = np.searchsorted(runs, r[at], side="right") - 1
                out[at] = firsts[run] + r[at] - runs[run]
            return {"container_kind": kinds, "container_no": out.tolist(), "id": ids, "piece": pieces, "first_token": begins, "tokens": lengths}

        return f

    return make


def pack(documents: DataFrame, limits: DataFrame, row_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, seed: int = 7) -> DataFrame:
    """(container_kind, container_no, id, piece, first_token, tokens): each text's place in the containers of every kind.

    A text of more tokens than the capacity is cut into full pieces and a rest, no other is cut. Null and empty texts take
    no place; repeated texts take one each. `limits` (container_kind, capacity_tokens) is a small table of distinct kinds
    with capacities above 0, others are left out; more than MAX_KINDS kinds are an error. An empty table gives no rows.
    """
    kinds = [(r[0], int(r[1])) for r in small_rows(limits.filter("capacity_tokens > 0 and container_kind is not null").select("container_kind", "capacity_tokens").distinct(), MAX_KINDS)]
    counted = cut_lineage(token_counts(documents, row_id, text, vocabulary=vocabulary).filter("tokens > 0").select("id", "tokens"))
    cap = F.element_at(F.create_map(*[F.lit(x) for k in kinds for x in k]), F.col("container_kind")).cast("long") if kinds else F.lit(1)
    each = counted.withColumn("container_kind", F.explode(F.array(*[F.lit(k) for k, _ in kinds]) if kinds else F.expr("cast(array() as array<string>)"))).withColumn("cap", cap)
    # full pieces by number; the rest, if any, after them
    pieces = each.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / F.col("cap")).cast("int"))))
    pieces = pieces.select("container_kind", "id", "piece", (F.col("piece") * F.col("cap")).alias("first_token"), F.least("cap", F.col("tokens") - F.col("piece") * F.col("cap")).alias("length"))
    histogram = pieces.groupBy("container_kind", "length").agg(F.count("*").alias("n")).collect()  # at most the capacity's number of rows a kind
    plans = {k: plan_slots({r["length"]: r["n"] for r in histogram if r["container_kind"] == k}, c)[0] for k, c in kinds}
    largest = max((r["n"] for r in histogram), default=0)
    slots = ranked(pieces, ["container_kind", "length"], F.xxhash64(F.lit(seed), "id", "piece"), largest)
    return map_columns(
        slots.select("container_kind", "id", "piece", "first_token", "length", "rank"), _place(plans),
        "container_kind string, container_no long, id long, piece int, first_token long, tokens long",
    )


def packed(spark, sf_dir: str) -> DataFrame:
    """p8_pack: documents in containers of all kinds."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return pack(read("documents"), read("pack_limits")).withColumnRenamed("id", "doc_id")


def usage(spark, sf_dir: str) -> DataFrame:
    """p8_usage: containers, tokens and the unused share by kind."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    total = packed(spark, sf_dir).groupBy("container_kind").agg((F.max("container_no") + 1).alias("containers"), F.sum("tokens").alias("tokens"))
    return total.join(read("pack_limits"), "container_kind").select(
        "container_kind", "containers", "tokens", "capacity_tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("unused_share"))
