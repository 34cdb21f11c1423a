"""Inputs: batch lines, local pages and archives, fetched pages through a pluggable fetcher, and a cache of what was fetched."""

from __future__ import annotations

import gzip
import io
import os
import re
import tarfile
import time
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions import text as T
from ..functions.session import cut_lineage

# ---- lines and files


def batch_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line, kind, arxiv fields): one input a line, n ascending with the lines; blank and comment lines stay as `skip` rows for the report.

    The lines are stored once, so that a line keeps its n whenever it is read again.
    """
    return cut_lineage(classify(spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))))


def classify(lines: DataFrame) -> DataFrame:
    """Adds kind and the arxiv fields; n, if the lines have it, stays."""
    return lines.withColumn("kind", T.input_kind(F.col("line"))).withColumn("arxiv", T.arxiv_input(F.col("line"))).select(*(["n"] if "n" in lines.columns else []), "line", "kind", "arxiv.*")


def read_files(inputs: DataFrame, key: str = "n", path: str = "line") -> DataFrame:
    """(key, content, error): files that all executors reach, each read by the task that holds its row; a missing one is its row's error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, p in zip(pdf["key"], pdf["path"]):
                try:
                    where, inside = fs.FileSystem.from_uri(p) if "://" in p else (fs.LocalFileSystem(), os.path.expanduser(p))
                    with where.open_input_stream(inside, compression=None) as f:
                        rows.append((k, f.read(), None))
                except (OSError, ValueError) as e:
                    rows.append((k, None, f"StorageError: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=["key", "content", "error"])

    df = inputs.select(F.col(key).alias("key"), F.trim(path).alias("path"))
    return df.mapInPandas(run, f"key {dict(inputs.dtypes)[key]}, content binary, error string").withColumnRenamed("key", key)


def local_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of HTML files, each in whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


#: First characters of a PDF, which servers send in place of TeX at times.
PDF_MAGIC = b"%PDF-"


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 5) == F.lit(PDF_MAGIC)


def archive_members(content: bytes | None) -> Iterator[tuple[str, bytes]]:
    """(path, bytes) of a zip, tar or gzip archive; members that would leave their folder are passed over, a broken archive gives none."""
    if not content or content[:5] == PDF_MAGIC:
        return
    try:
        if content[:2] == b"PK":
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                members = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
        else:
            raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
            try:
                with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                    members = [(m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile()]
            except tarfile.ReadError:
                members = [("main.tex", raw)]
    except (OSError, zipfile.BadZipFile, tarfile.TarError, EOFError, ValueError):
        return
    for name, data in members:
        parts = name.replace("\\", "/").split("/")
        if name and not name.startswith("/") and ".." not in parts:
            yield "/".join(p for p in parts if p not in ("", ".")), data


#: Bytes and members from which on a batch of members goes out.
BATCH_BYTES, BATCH_ROWS = 8_000_000, 10_000


def extract(archives: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, path, content, size) of all members of all archives."""
    kind = dict(archives.dtypes)[key]

    schema = f"doc_id {kind}, path string, content binary, size long"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                # archives share a batch, and a large one takes several
                for p, d in archive_members(c):
                    rows.append((k, p, d, len(d)))
                    held += len(d)
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)

    return archives.select(F.col(key).alias("doc_id"), F.col(content).alias("content")).mapInArrow(run, schema)


#: File names by which a paper's main file goes, best first.
MAIN_TEX, MAIN_HTML = ("main.tex", "paper.tex", "article.tex"), ("index", "full_article", "article", "main", "abstract")


def main_tex(files: DataFrame) -> DataFrame:
    """(doc_id, main): an only file; a usual name in the root; a root file that is a document; a file named by its id; the largest in the root; the largest."""
    t = files.filter(F.lower("path").endswith(".tex"))
    text = F.decode("content", "utf-8")
    name, root = F.element_at(F.split("path", "/"), -1), ~F.contains("path", F.lit("/"))
    whole = text.contains("\\documentclass") & text.contains("\\begin{document}")
    usual = F.array_position(F.array(*map(F.lit, MAIN_TEX)), F.col("path"))
    rank = F.when(usual > 0, usual).when(root & whole, 10).when(name.rlike(r"\d{4}\.\d{4,5}"), 20).when(root, 30).otherwise(40)
    # an only file is the best of one whatever its rank; contents don't leave their row
    return t.withColumn("_rank", rank).groupBy("doc_id").agg(F.min(F.struct("_rank", F.when(F.col("_rank") >= 30, -F.col("size")), "path"))["path"].alias("main"))


def main_html(files: DataFrame) -> DataFrame:
    """(doc_id, main): by usual names in order, else the largest page."""
    h = files.filter(F.lower("path").rlike(r"\.html?$"))
    stem = F.lower(F.regexp_extract("path", r"([^/]*)\.[^.]*$", 1))
    at = F.array_position(F.array(*map(F.lit, MAIN_HTML)), stem)
    return h.groupBy("doc_id").agg(F.min(F.struct(F.when(at > 0, at).otherwise(99), -F.col("size"), "path"))["path"].alias("main"))


def image_inventory(files: DataFrame) -> DataFrame:
    """(doc_id, path, stem, extension, size) of an archive's images."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    return files.withColumn("extension", ext).filter(F.col("extension").isin("png", "jpg", "jpeg", "pdf", "eps", "ps")).select("doc_id", "path", F.regexp_extract("path", r"([^/]*)\.[^.]*$", 1).alias("stem"), "extension", "size")


# ---- what comes over the network: a fetcher is a function url -> (status, content type, body)

Fetcher = Callable[[str], tuple[int, str, bytes]]
#: Statuses worth another try.
RETRY = frozenset((429, 500, 502, 503, 504))
#: The title of a page that stands for a paper without one.
PLACEHOLDER = r"<title>\s*No content available\s*</title>"


def is_placeholder(html: Column) -> Column:
    return F.coalesce(html.rlike(PLACEHOLDER), F.lit(False))


def fetch_with_retries(fetch: Fetcher, url: str, tries: int = 3, backoff_s: float = 3.0, wait: Callable[[float], None] = time.sleep) -> tuple[int, str, bytes | None, str | None]:
    """(status, type, body, error): 404 and other statuses end it, retryable ones are tried again after backoff·2^k; never raises."""
    status, kind, body = 0, "", None
    for k in range(tries):
        try:
            status, kind, body = fetch(url)
        except Exception as e:  # noqa: BLE001 - any failure of the fetcher is a row's error
            status, kind, body, reason = 0, "", None, f"{type(e).__name__}: {e}"
        else:
            reason = f"status {status}"
            if status == 200:
                return status, kind, body, None
            if status == 404:
                return status, kind, None, "not found"
            if status not in RETRY:
                return status, kind, None, reason
        if k + 1 < tries:
            wait(backoff_s * 2**k)
    return status, kind, None, reason


def _with_fetcher(make_fetcher: Callable[[], Fetcher], one: Callable[[Fetcher, tuple], tuple], columns: list[str]):
    """A partition's rows through one fetcher, which is closed behind them if it can be."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch = make_fetcher()
        try:
            for pdf in batches:
                yield pd.DataFrame([one(fetch, tuple(None if x != x else x for x in row)) for row in pdf.itertuples(index=False)], columns=columns)
        finally:
            getattr(fetch, "close", lambda: None)()

    return run


def fetch_pages(inputs: DataFrame, make_fetcher: Callable[[], Fetcher], key: str = "id", urls: tuple[str, ...] = ("html_url", "ar5iv_url"), tries: int = 3, backoff_s: float = 3.0, partitions: int | None = None, delay_s: float = 0.0) -> DataFrame:
    """(key, url, html, error): the first address that has a page, the next being tried where one isn't found. A placeholder page is an error.

    One fetcher a partition; the partitions bound the concurrency, and a delay spaces their requests.
    """

    def one(fetch: Fetcher, row: tuple) -> tuple:
        url, error = None, "no address"
        for url in [u for u in row[1:] if u]:
            if delay_s:
                time.sleep(delay_s)
            _, kind, body, error = fetch_with_retries(fetch, url, tries, backoff_s)
            if body is not None:
                page = body.decode("utf-8", "replace")
                error = f"content type {kind}" if "text/html" not in kind else "no page for this source" if re.search(PLACEHOLDER, page) else None
                return row[0], url, None if error else page, error
            if error != "not found":
                break
        return row[0], url, None, error

    df = inputs.select(key, *urls)
    df = df.repartition(partitions) if partitions else df
    return df.mapInPandas(_with_fetcher(make_fetcher, one, ["key", "url", "html", "error"]), f"key {dict(inputs.dtypes)[key]}, url string, html string, error string").withColumnRenamed("key", key)


def fetch_files(inputs: DataFrame, make_fetcher: Callable[[], Fetcher], key: str = "id", url: str = "url", tries: int = 3, backoff_s: float = 3.0, tex: bool = False) -> DataFrame:
    """(key, content, error): a paper's PDF or its archive. With `tex`, a PDF served in the place of TeX counts as not found, told by its type or its first bytes."""

    def one(fetch: Fetcher, row: tuple) -> tuple:
        if not row[1]:
            return row[0], None, "no address"
        _, kind, body, error = fetch_with_retries(fetch, row[1], tries, backoff_s)
        if body is not None and tex and ("application/pdf" in kind or body[:5] == PDF_MAGIC):
            return row[0], None, "not found"
        return row[0], body, error

    return inputs.select(key, url).mapInPandas(_with_fetcher(make_fetcher, one, ["key", "content", "error"]), f"key {dict(inputs.dtypes)[key]}, content binary, error string").withColumnRenamed("key", key)


def fetch_records(inputs: DataFrame, make_fetcher: Callable[[], Fetcher], key: str = "id", url: str = "url", tries: int = 3, backoff_s: float = 3.0) -> DataFrame:
    """(key, body): an answer of a metadata service as text, null where there is none: what isn't found or fails is no error here."""

    def one(fetch: Fetcher, row: tuple) -> tuple:
        body = fetch_with_retries(fetch, row[1], tries, backoff_s)[2] if row[1] else None
        return row[0], None if body is None else body.decode("utf-8", "replace")

    return inputs.select(key, url).mapInPandas(_with_fetcher(make_fetcher, one, ["key", "body"]), f"key {dict(inputs.dtypes)[key]}, body string").withColumnRenamed("key", key)


def record_urls(ident: Column, doi: Column) -> Column:
    """Addresses of a paper's records: feed, abstract page, registry and aggregator."""
    base = T.without_version(ident)
    return F.struct(
        F.concat(F.lit("https://export.arxiv.org/api/query?id_list="), ident).alias("atom"), F.concat(F.lit("https://arxiv.org/abs/"), base).alias("abs"),
        F.when(~T.is_arxiv_doi(doi), F.concat(F.lit("https://api.crossref.org/works/"), F.regexp_replace(doi, r"^(?:https?://(?:dx\.)?doi\.org/|doi:)", ""))).alias("crossref"),
        F.concat(F.lit("https://api.openalex.org/works/https://doi.org/10.48550/arXiv."), base).alias("openalex"),
    )


def through_cache(inputs: DataFrame, cache: DataFrame, ttl_s: int, now: Column | None = None, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(fresh, missing): inputs whose cached copy (key, content, fetched_at) is young enough, and the others. A ttl of 0 or less keeps every copy."""
    now = F.current_timestamp() if now is None else now
    latest = cache.groupBy(key).agg(F.max_by("content", "fetched_at").alias("content"), F.max("fetched_at").alias("fetched_at"))
    j = inputs.join(latest, key, "left")
    good = T.is_fresh(F.col("fetched_at"), now, ttl_s)
    return j.filter(good), j.filter(~good).drop("content", "fetched_at")


def lookup(inputs: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Best-effort lookup in a table of fetched records: no record gives nulls."""
    return inputs.join(table, key, "left")
