"""Traversal of parsed documents as rows in pre-order: visits, counts, texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .outline import rows_union
from .pages import inlines_of


def nodes(parsed: DataFrame) -> DataFrame:
    """(doc_id, place, type, text): the document, its metadata, authors, sections, blocks and inline tokens in pre-order."""
    doc = parsed.select("doc_id", F.array(F.lit(-3)).alias("place"), F.lit("document").alias("type"), F.col("title").alias("text"))
    meta = parsed.select("doc_id", F.array(F.lit(-2)).alias("place"), F.lit("metadata").alias("type"), F.col("title").alias("text"))
    authors = parsed.select("doc_id", F.posexplode("authors").alias("i", "a")).select("doc_id", F.array(F.lit(-2), F.col("i")).alias("place"), F.lit("author").alias("type"), F.col("a.name").alias("text"))
    sections = parsed.select("doc_id", F.inline("sections")).select("doc_id", F.array("pos").alias("place"), F.lit("section").alias("type"), F.col("title").alias("text"))
    blocks = parsed.select("doc_id", F.inline("blocks")).select("doc_id", F.coalesce("sec_pos", F.lit(-1)).alias("s"), F.col("pos").alias("p"), "kind", "text")
    tokens = inlines_of(parsed).filter("op != 'close'").join(blocks.select("doc_id", F.col("p").alias("pos"), "s"), ["doc_id", "pos"])
    return rows_union([
        doc, meta, authors, sections, blocks.select("doc_id", F.array("s", "p").alias("place"), F.col("kind").alias("type"), "text"),
        tokens.select("doc_id", F.array("s", "pos", "i").alias("place"), F.when(F.col("op") == "open", F.when(F.col("style") == "link", "link").when(F.col("style").isin("superscript", "subscript"), F.col("style")).otherwise("emphasis")).when(F.col("op") == "cite", "link").otherwise(F.col("op")).alias("type"), "text"),
    ])


def visit(tree: DataFrame, rules: dict[str, Column], default: Column | None = None, name: str = "value") -> DataFrame:
    """Adds the value of the rule for each node's type; other nodes get the default."""
    out = F.lit(None).cast("string") if default is None else default
    for kind, rule in rules.items():
        out = F.when(F.col("type") == kind, rule).otherwise(out)
    return tree.withColumn(name, out)


def counts(tree: DataFrame) -> DataFrame:
    return tree.groupBy("doc_id", "type").agg(F.count("*").alias("n"))


def texts(tree: DataFrame) -> DataFrame:
    """(doc_id, texts): text tokens in order."""
    return tree.filter("type = 'text'").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "text")))["text"].alias("texts"))
