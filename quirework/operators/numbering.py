"""Numbers, anchors, links and order of figures, tables, equations and algorithms.

Blocks are (doc_id, pos, kind, caption, ...), `pos` being their order in the document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KINDS = ("figure", "table", "algorithm")


def number_blocks(blocks: DataFrame, doc: str = "doc_id", pos: str = "pos", kind: str = "kind", claimed: str = "claimed") -> DataFrame:
    """Adds number: the caption's own, or for the k-th block of a kind without one the k-th positive integer that no caption claims.

    With claimed integers c1 < c2 < ... the k-th free one is k plus the number of those with c_i - i < k, which needs
    no loop. Equations are counted in order.
    """
    free = Window.partitionBy(doc, kind).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = blocks.filter(F.col(claimed).isNotNull() & (F.col(kind) != "equation")).groupBy(doc, kind).agg(F.array_sort(F.collect_set(claimed)).alias("_c"))
    d = blocks.join(taken, [doc, kind], "left").withColumn("_k", F.sum((F.col(claimed).isNull() | (F.col(kind) == "equation")).cast("int")).over(free))
    skipped = F.size(F.filter(F.coalesce("_c", F.expr("cast(array() as array<int>)")), lambda c, i: c - (i + 1) < F.col("_k")))
    number = F.when(F.col(kind) == "equation", F.col("_k")).when(F.col(claimed).isNotNull(), F.col(claimed)).otherwise(F.col("_k") + skipped)
    return d.withColumn("number", number.cast("int")).drop("_c", "_k")


def block_id(kind: Column, number: Column) -> Column:
    """figure-3, table-1, algorithm-2, eq-4."""
    return F.concat(F.when(kind == "equation", "eq").otherwise(kind), F.lit("-"), F.coalesce(number.cast("string"), F.lit("?")))


def block_anchor(kind: Column, ident: Column, label: Column, number: Column) -> Column:
    """Figures and tables by id, then label; equations and algorithms by label, then number; headings by label alone."""
    label = F.nullif(label, F.lit(""))
    return (
        F.when(kind.isin("figure", "table"), F.coalesce(F.nullif(ident, F.lit("")), label)).when(kind == "equation", F.coalesce(label, block_id(kind, number)))
        .when(kind == "algorithm", F.coalesce(label, F.concat(F.lit("alg-"), number.cast("string")))).when(kind == "heading", label)
    )


def _distinct_anchors(bases: pd.Series) -> pd.Series:
    """For each document's bases in order: the base itself if it is free, else with the first number from 2 on that is."""

    def one(items: list[str | None]) -> list[str | None]:
        used: set[str] = set()
        after: dict[str, int] = {}
        out = []
        for base in items:
            anchor = base
            if base in used:
                n = after.get(base, 2)
                while f"{base}-{n}" in used:
                    n += 1
                anchor, after[base] = f"{base}-{n}", n + 1
            if base is not None:
                used.add(anchor)
            out.append(anchor)
        return out

    return bases.map(one)


def unique_anchors(blocks: DataFrame, doc: str = "doc_id", pos: str = "pos", base: str = "base") -> DataFrame:
    """Adds anchor: the base if no block before has it, else base-2, base-3 and so on, the first that none before has. A null base has none.

    A document's bases are gathered with their places, named in order and joined back: whether a name is free depends on all before it.
    """
    of = blocks.filter(F.col(base).isNotNull()).groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(base).alias("b")))).alias("_x"))
    name = F.pandas_udf(_distinct_anchors, "array<string>")
    made = of.select(doc, F.explode(F.arrays_zip(F.col("_x.p").alias("p"), name(F.col("_x.b")).alias("a"))).alias("_y")).select(doc, F.col("_y.p").alias(pos), F.col("_y.a").alias("anchor"))
    # names outgrow the rows they are made from, so their size as it is estimated doesn't tell whether they can be broadcast
    return blocks.drop("anchor").join(made.hint("merge"), [doc, pos], "left")


def point_links(links: DataFrame, blocks: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Internal links whose target is a block's label go to that block's anchor; of equal labels the last block counts."""
    labels = blocks.filter("label is not null and label != ''").groupBy(doc, F.col("label").alias("target_id")).agg(F.max_by("anchor", pos).alias("_to"))
    return links.join(labels, [doc, "target_id"], "left").withColumn("target", F.coalesce("_to", "target_id")).drop("_to")


def reorder_figures(blocks: DataFrame, doc: str = "doc_id", scope: str = "scope", pos: str = "pos", kind: str = "kind", text: str = "text", number: str = "number") -> DataFrame:
    """Adds new_pos: a figure that stands after the first paragraph citing it moves right behind that paragraph.

    Several figures behind one paragraph come out in reverse order. Only blocks of one list (scope) count.
    """
    cites = blocks.filter(F.col(kind) == "paragraph").select(doc, scope, F.col(pos).alias("_at"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)Fig(?:ure)?\.?\s*(\d+)"), F.lit(1)))).alias("_n"))
    cites = cites.select(doc, scope, "_at", F.expr("try_cast(_n as int)").alias(number))
    first = cites.groupBy(doc, scope, number).agg(F.min("_at").alias("_cite"))
    d = blocks.join(first, [doc, scope, number], "left")
    moves = (F.col(kind) == "figure") & (F.col("_cite") < F.col(pos))
    order = [F.when(moves, F.col("_cite")).otherwise(F.col(pos)), moves.cast("int"), F.when(moves, -F.col(pos)).otherwise(0)]
    return d.withColumn("new_pos", F.row_number().over(Window.partitionBy(doc, scope).orderBy(*order))).drop("_cite")
