"""Citations: entries from pages and text, identifiers, resolution against lookup tables, BibTeX."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.dom import flat, parse


def page_entries(html: str | None) -> list[tuple[str, str]]:
    """(key, text): list items of the bibliography, else its items of another kind, else every cite."""
    root = parse(html)
    box = root.first("section", "ltx_bibliography") or root.first("ul", "ltx_biblist")
    if box is not None:
        items = list(box.all("li")) or list(box.all("p div span", "ltx_bibitem"))
        return [(e.get("id").removeprefix("bib.") or f"bib{n}", flat(e.text())) for n, e in enumerate(items, 1) if e.text().strip()]
    return [(f"cite{n}", flat(e.text())) for n, e in enumerate(root.all("cite"), 1) if e.text().strip()]


def from_pages(pages: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """(doc_id, ord, key, text, identifiers)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, n, k, t) for d, h in zip(pdf["doc_id"], pdf["html"]) for n, (k, t) in enumerate(page_entries(h))]
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "key", "text"])

    got = pages.select(F.col(key).alias("doc_id"), F.col(html).alias("html")).mapInPandas(run, f"doc_id {dict(pages.dtypes)[key]}, ord int, key string, text string")
    return got.withColumn("identifiers", T.identifiers(F.col("text")))


#: How a line begins a reference: `[n]`, `n.` or a family name with a comma.
ENTRY_START = r"^\s*(?:\[\d+\]|\d+\.\s|\p{Lu}[\p{L}'’-]+,)"


def from_text(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ord, key, text): a line that begins a reference starts an entry, others continue the one before.

    A first line that begins none still starts an entry. Lines are numbered in the row; a running count of starts over the
    document's lines tells the entries.
    """
    lines = texts.select(F.col(key).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("n", "line")).filter(F.trim("line") != "")
    w = Window.partitionBy("doc_id").orderBy("n")
    first = F.row_number().over(w) == 1
    entry = F.sum((F.col("line").rlike(ENTRY_START) | first).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = lines.withColumn("_first", first).withColumn("ord", entry)
    return d.groupBy("doc_id", "ord").agg(F.array_join(F.sort_array(F.collect_list(F.struct("n", F.trim("line").alias("l"))))["l"], " ").alias("text")).select(
        "doc_id", "ord", F.concat(F.lit("ref"), F.col("ord").cast("string")).alias("key"), "text"
    )


def resolve(citations: DataFrame, dois: DataFrame, arxiv: DataFrame, strict_parity: bool = False) -> DataFrame:
    """Citations with a record: by DOI, else by arXiv id, else from the text.

    dois and arxiv: (id, record struct<title, authors, year, journal, ...>). From the text the title is its first 100
    characters and the year a four-digit one; strict_parity keeps the known quirk of a year cut to its century.
    """
    c = citations.withColumn("_doi", F.lower(F.col("identifiers")["doi"])).withColumn("_arxiv", T.without_version(F.col("identifiers")["arxiv"]))
    c = c.join(dois.select(F.lower("id").alias("_doi"), F.col("record").alias("_r1")), "_doi", "left").join(arxiv.select(T.without_version(F.col("id")).alias("_arxiv"), F.col("record").alias("_r2")), "_arxiv", "left")
    title = F.when(F.length("text") > 100, F.concat(F.substring("text", 1, 100), F.lit("..."))).otherwise(F.col("text"))
    year = F.nullif(F.regexp_extract("text", r"\b(19|20)\d{2}\b", 1 if strict_parity else 0), F.lit(""))
    source = F.when(F.col("_r1").isNotNull(), "doi").when(F.col("_r2").isNotNull(), "arxiv").otherwise("text")
    pick = lambda f: F.coalesce(F.col(f"_r1.{f}"), F.when(F.col("_r1").isNull(), F.col(f"_r2.{f}")))
    none = F.col("_r1").isNull() & F.col("_r2").isNull()
    return c.select(
        *citations.columns, source.alias("resolved_by"), F.when(none, title).otherwise(pick("title")).alias("title"), F.coalesce(pick("authors"), F.expr("cast(array() as array<string>)")).alias("authors"),
        F.when(none, year).otherwise(pick("year")).alias("year"), pick("journal").alias("journal"), F.when(none, "misc").otherwise("article").alias("entry_type"),
    )


def bibtex(entries: DataFrame, doc: str = "arxiv_id") -> DataFrame:
    """(doc, key, entry) in BibTeX; equal keys of a document are told apart by a number."""
    cols = set(entries.columns)
    base = T.citation_key(F.col("authors"), F.col("year"), F.col("title"))
    d = entries.withColumn("_base", base)
    nth = F.row_number().over(Window.partitionBy(doc, "_base").orderBy("ord")) - 1
    key = F.concat("_base", F.when(nth > 0, nth.cast("string")).otherwise(""))
    fields = {n: (T.bibtex_authors(F.col("authors")) if n == "author" else F.col(s)) for n, s in (("title", "title"), ("author", "authors"), ("year", "year"), ("journal", "journal"), ("booktitle", "booktitle"), ("volume", "volume"), ("number", "issue"), ("pages", "pages"), ("doi", "doi"), ("url", "url"), ("publisher", "publisher"), ("abstract", "abstract"), ("note", "note")) if s in cols}
    return d.withColumn("key", key).select(doc, "ord", "key", T.bibtex_entry(F.coalesce("entry_type", F.lit("misc")), F.col("key"), fields).alias("entry"))
