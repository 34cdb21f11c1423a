"""Batch runs: inputs by kind, each through its reader, with errors as rows, and a report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage
from ..operators import images as IM
from ..operators import pages as P
from ..operators import tex as TX
from ..sources import inputs as I
from . import pipeline as PL

#: Classes of errors and a command's exit code for them. An error is a row's text that begins with its class.
ERRORS = {
    "Error": 1, "UserInputError": 2, "NetworkError": 1, "IngestionError": 1, "ImageProcessingError": 1, "PDFConversionError": 1, "StorageError": 1, "ParseError": 1,
    "ParserNotAvailableError": 1, "BuilderError": 1, "TransformError": 1, "EmitterError": 1,
}


def error_class(error: Column) -> Column:
    """The class that an error's text begins with, `Error` for another; null without an error."""
    name = F.regexp_extract(error, r"^(\w+)(?::|$)", 1)
    return F.when(error.isNotNull(), F.when(name.isin(list(ERRORS)), name).otherwise("Error"))


def route(inputs: DataFrame) -> dict[str, DataFrame]:
    """Inputs by kind: each goes to the reader that can take it."""
    return {k: inputs.filter(F.col("kind") == k) for k in ("arxiv", "local_html", "local_archive", "skip", "unknown")}


@dataclass(frozen=True)
class Sources:
    """What a batch's inputs became: pages (doc_id, html) and TeX files (doc_id, path, content, main, size) by the line's number, and the errors (doc_id, error)."""

    pages: DataFrame
    tex: DataFrame
    errors: DataFrame


def gather(lines: DataFrame, make_fetcher: Callable[[], I.Fetcher] | None = None, parser: str = "html", tries: int = 3, backoff_s: float = 3.0, partitions: int | None = None, delay_s: float = 0.0) -> Sources:
    """Every input of a batch read or fetched: arXiv ids as pages or, with the parser `latex`, as TeX archives; local pages; local archives, TeX first, else their page.

    lines: n, line, kind and the arXiv fields. What can't be had is an error of its line and holds up no other.
    """
    by = route(lines)
    no = lambda df, why: df.select(F.col("n").alias("doc_id"), F.lit(why).alias("error"))
    errors = [no(by["unknown"], "UserInputError: neither an arXiv id nor a page or archive")]
    local = I.read_files(by["local_html"])
    pages = [local.filter("error is null").select(F.col("n").alias("doc_id"), F.decode("content", "utf-8").alias("html"))]
    stored = I.read_files(by["local_archive"])
    archives = [stored.filter("error is null").select(F.col("n").alias("doc_id"), "content")]
    errors += [x.filter("error is not null").select(F.col("n").alias("doc_id"), "error") for x in (local, stored)]
    if make_fetcher is None:
        errors.append(no(by["arxiv"], "NetworkError: no fetcher is installed"))
    else:
        if parser == "latex":
            asked = by["arxiv"].withColumn("url", F.concat(F.lit("https://arxiv.org/e-print/"), "id"))
            got = cut_lineage(I.fetch_files(asked, make_fetcher, "n", "url", tries, backoff_s, tex=True))
            archives.append(got.filter("error is null").select(F.col("n").alias("doc_id"), "content"))
        else:
            got = cut_lineage(I.fetch_pages(by["arxiv"], make_fetcher, "n", tries=tries, backoff_s=backoff_s, partitions=partitions, delay_s=delay_s))
            pages.append(got.filter("error is null").select(F.col("n").alias("doc_id"), "html"))
        errors.append(got.filter("error is not null").select(F.col("n").alias("doc_id"), F.concat(F.lit("NetworkError: "), "error").alias("error")))
    every = reduce(DataFrame.unionByName, archives)
    files = cut_lineage(I.extract(every))
    main, page = I.main_tex(files), I.main_html(files)
    tex = files.join(main, "doc_id")
    alone = page.join(main, "doc_id", "left_anti").withColumnRenamed("main", "path")
    pages.append(files.join(alone, ["doc_id", "path"], "left_semi").select("doc_id", F.decode("content", "utf-8").alias("html")))
    nothing = every.select("doc_id").join(main.select("doc_id").unionByName(page.select("doc_id")).distinct(), "doc_id", "left_anti")
    errors.append(nothing.select("doc_id", F.lit("IngestionError: an archive without a TeX file or a page").alias("error")))
    return Sources(reduce(DataFrame.unionByName, pages), tex, reduce(DataFrame.unionByName, errors))


def convert_all(sources: Sources, options: PL.Options = PL.Options()) -> list[PL.Tables]:
    """Tables of the pages and of the TeX documents. Sections are numbered where the source is TeX, and its images point to the archive's files."""
    texts = sources.tex.filter(~F.lower("path").rlike(r"\.(?:png|jpe?g|gif|pdf|e?ps|svg|zip|gz|tar)$"))
    parsed = TX.parse_archives(texts.select("doc_id", "path", "content", "main"))
    tables = PL.from_parsed(parsed, replace(options, number_sections=True))
    found = I.image_inventory(sources.tex.select("doc_id", "path", "size"))
    tables = replace(tables, blocks=IM.with_sources(tables.blocks, found))
    return [PL.from_parsed(P.parse_pages(sources.pages), options).transform(*PL.DEFAULT), tables.transform(*PL.DEFAULT)]


def run_batch(lines: DataFrame, options: PL.Options = PL.Options(), make_fetcher: Callable[[], I.Fetcher] | None = None, parser: str = "html", **fetching: object) -> tuple[DataFrame, DataFrame]:
    """(documents, outcomes) of a batch from its lines to its outputs.

    documents: doc_id (the line's n), title, summary, sections_tree, content, content_references, content_appendix, sha256.
    outcomes: n, line, status (ok, error, skip), error, one row a line: repeated lines are lines of their own.
    """
    sources = gather(lines, make_fetcher, parser, **fetching)
    documents = cut_lineage(reduce(DataFrame.unionByName, [outputs(t) for t in convert_all(sources, options)]))
    j = lines.select("n", "line", "kind").join(sources.errors.withColumnRenamed("doc_id", "n"), "n", "left").join(documents.select(F.col("doc_id").alias("n"), F.lit(True).alias("_done")), "n", "left")
    error = F.when(F.col("kind") != "skip", F.coalesce("error", F.when(F.col("_done").isNull(), "IngestionError: no document came out")))
    status = F.when(F.col("kind") == "skip", "skip").when(error.isNull(), "ok").otherwise("error")
    return documents, j.select("n", "line", status.alias("status"), error.alias("error"))


def with_stubs(fetched: DataFrame) -> DataFrame:
    """A page that couldn't be had becomes a stub that says so, so that a record comes out for every input."""
    return fetched.withColumn("html", F.coalesce("html", F.concat(F.lit("<article><h1 class='ltx_title'>"), F.col("id"), F.lit("</h1></article>")))).withColumn("is_stub", F.col("error").isNotNull())


def outputs(tables: PL.Tables, counted: DataFrame | None = None) -> DataFrame:
    """(doc_id, title, summary, sections_tree, content, content_references, content_appendix, sha256)."""
    t = PL.stored(tables)
    out = PL.summary(t, counted).join(PL.to_markdown(t), "doc_id", "left").join(PL.content_fingerprint(t), "doc_id", "left")
    return t.docs.select("doc_id", "title").join(out, "doc_id")


def ingest(pages: DataFrame, options: PL.Options = PL.Options(), counted: DataFrame | None = None, key: str = "doc_id", html: str = "html") -> DataFrame:
    """A page's outputs, see `outputs`."""
    return outputs(PL.convert(pages, key, html, options), counted)


def report(outcomes: DataFrame) -> DataFrame:
    """(status, n) over ok, error and skip, of rows with a status."""
    return outcomes.groupBy("status").agg(F.count("*").alias("n"))


def until_first_error(outcomes: DataFrame) -> DataFrame:
    """Outcomes up to the first line in error, as a run that stops there has them."""
    first = outcomes.filter("status = 'error'").agg(F.min("n").alias("n")).first()["n"]
    return outcomes if first is None else outcomes.filter(F.col("n") <= first)


def exit_code(counts: DataFrame) -> int:
    return int(counts.filter("status = 'error' and n > 0").limit(1).count() > 0)


def fail_fast(results: DataFrame) -> DataFrame:
    """The same rows, but the first error ends the run."""
    return results.filter(F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.lit(True)))


def images_only(pages: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """(doc_id, pos, src, alt): images of the pages' figures."""
    b = P.blocks_of(P.parse_pages(pages, key, html))
    return b.select("doc_id", "pos", F.explode("images").alias("i")).select("doc_id", "pos", "i.src", "i.alt")
