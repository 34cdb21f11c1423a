"""Sinks: Markdown, JSON, graph and BibTeX files, written by the executors."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.session import cut_lineage
from .yaml_files import dump


def write_text(df: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """One folder per name with the text in it; an existing one is replaced."""
    df.select(name, F.col(text).alias("value")).filter("value is not null").write.mode("overwrite").partitionBy(name).option("lineSep", "\n").text(path)


def write_markdown(markdown: DataFrame, path: str) -> None:
    """content, content_references and content_appendix of each document; parts that are absent leave nothing behind."""
    parts = {"paper": "content", "references": "content_references", "appendix": "content_appendix"}
    rows = F.explode(F.create_map(*[x for k, c in parts.items() for x in (F.lit(k), F.col(c))])).alias("part", "value")
    markdown.select("doc_id", rows).filter("value is not null").write.mode("overwrite").partitionBy("doc_id", "part").text(path)


def write_bundle(path: str, json: DataFrame | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None, bibtex: DataFrame | None = None) -> None:
    if json is not None:
        json.select("json").write.mode("overwrite").text(f"{path}/json")
    for name, df in (("nodes", nodes), ("edges", edges)):
        if df is not None:
            df.write.mode("overwrite").option("header", True).csv(f"{path}/graph/{name}")
    if bibtex is not None:
        bibtex.select("entry").write.mode("overwrite").text(f"{path}/bibtex")


def write_records(records: DataFrame, path: str) -> None:
    """Paper records (arxiv_id, record as JSON) as YAML, one folder a paper."""

    @F.pandas_udf(StringType())
    def to_yaml(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else dump(json.loads(t)))

    write_text(records.select(F.replace("arxiv_id", F.lit("/"), F.lit("_")).alias("name"), to_yaml("record").alias("text")), path)


def result_lines(df: DataFrame) -> DataFrame:
    """One machine-readable line a row."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_svgs(assets: DataFrame, path: str) -> int:
    """Inline SVGs with content; how many there were."""
    svgs = cut_lineage(assets.filter((F.col("kind") == "svg") & F.col("content").isNotNull()))
    write_text(svgs, path, "path", "content")
    return svgs.count()
