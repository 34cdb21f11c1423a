"""Queries of sources, metadata, images, citations and batch runs.

What comes over a network or from archives is made from a table's columns by a stand-in for the server, so that the SQL can tell
from the same columns what must come out. Every query reads its whole table.
"""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from .. import settings as S
from ..functions import text as T
from ..functions.session import cut_lineage, shared_folder, spread, table
from ..operators import authors as A
from ..operators import citations as C
from ..operators import graph as G
from ..operators import images as I
from ..operators import metadata as M
from ..operators import numbering as N
from ..operators import pages as P
from ..operators import traverse
from ..sources import inputs, sinks, yaml_files
from . import batch
from . import pipeline as PL
from .markup_queries import page, parts, section

_X = "'X' || translate(p_partkey::VARCHAR, '0123456789', 'abcdefghij')"


def _x() -> Column:
    return F.concat(F.lit("X"), F.translate(F.col("p_partkey").cast("string"), "0123456789", "abcdefghij"))


def _part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").withColumn("doc_id", F.col("p_partkey")).withColumn("x", _x())


# ---- inputs


def input_kinds(spark, d):
    """Lines of a batch by kind, local ones among them, in ten spellings."""
    spelled = ["./‹key›/a.html", "/data/‹key›.HTM", "~/p/‹key›.tar.gz", "a/‹key›.tgz", "../‹key›.zip", "2101.‹key›", "# ‹name›", "   ", "‹name›.html", "https://x.org/‹key›.html"]
    made = parts(spark, d, **{f"k{k}": t for k, t in enumerate(spelled)})
    return made.select("doc_id", F.posexplode(F.array(*[f"k{k}" for k in range(len(spelled))])).alias("form", "line")).select("doc_id", "form", T.input_kind(F.col("line")).alias("kind"))


class _Server:
    """Stands in for a server: what an address gives follows from the number in it; some answers come after a failure."""

    def __init__(self) -> None:
        self.asked: dict[str, int] = {}

    def __call__(self, url: str) -> tuple[int, str, bytes]:
        n = int(re.search(r"(\d+)$", url)[1])
        self.asked[url] = self.asked.get(url, 0) + 1
        if n % 11 == 0 and self.asked[url] == 1:
            return 503, "", b""
        if "tex" in url:
            return (200, "application/pdf", b"x") if n % 5 == 1 else (200, "application/gzip", b"%PDF-1.4") if n % 5 == 2 else (404, "", b"") if n % 5 == 3 else (200, "application/gzip", b"tar " + str(n).encode())
        if n % 7 == 1 and "html" in url:
            return 404, "", b""
        if n % 7 == 2:
            return 404, "", b""
        if n % 7 == 3:
            return 200, "text/html", b"<html><title> No content available </title></html>"
        if n % 7 == 4:
            return 200, "application/pdf", b"%PDF-"
        if n % 7 == 5:
            return 403, "", b""
        return 200, "text/html; charset=utf-8", page(section(f"<p>text of {n}</p>", f"Head {n}"), f"Title {n}").encode()


def page_fetch(spark, d):
    """Pages through a fetcher: a second address where the first isn't found, failures tried again, placeholders refused."""
    asked = table(spark, d, "papers").select("paper_id", F.concat(F.lit("https://x/html/"), F.col("paper_id").cast("string")).alias("html_url"), F.concat(F.lit("https://x/ar5iv/"), F.col("paper_id").cast("string")).alias("ar5iv_url"))
    got = inputs.fetch_pages(asked, _Server, "paper_id", tries=2, backoff_s=0.0)
    return got.select("paper_id", F.regexp_extract("url", r"x/(\w+)/", 1).alias("at"), F.regexp_extract("html", r"text of (\d+)", 1).alias("read"), "error")


def tex_fetch(spark, d):
    """Archives through a fetcher: a PDF in their place, told by its type or first bytes, isn't found."""
    asked = table(spark, d, "papers").select("paper_id", F.concat(F.lit("https://x/tex/"), F.col("paper_id").cast("string")).alias("url"))
    return inputs.fetch_files(asked, _Server, "paper_id", tries=2, backoff_s=0.0, tex=True).select("paper_id", F.decode("content", "utf-8").alias("content"), "error")


def placeholder_pages(spark, d):
    """Pages that only stand for a paper."""
    forms = ["<title> No content available </title>", "<title>No content available‹key›</title>", "<title>‹name›</title>No content available"]
    made = parts(spark, d, **{f"k{k}": t for k, t in enumerate(forms)})
    return made.select("doc_id", F.posexplode(F.array(*[f"k{k}" for k in range(3)])).alias("form", "html")).select("doc_id", "form", inputs.is_placeholder(F.col("html")).alias("refused"))


@F.pandas_udf(BinaryType())
def _zipped(keys: pd.Series) -> pd.Series:
    """An archive for each number, of files that follow from it."""

    def one(n: int) -> bytes:
        whole = "\\documentclass{a}\\begin{document}" + str(n)
        files = {0: {"only/x.tex": "a"}, 1: {"supp/main.tex": "a", "root.tex": whole}, 2: {"a.tex": whole, "paper.tex": "b"}, 3: {"2101.00001.tex": "a", "big.tex": "b" * 9}, 4: {"a.tex": "a", "b.tex": "bb", "s/c.tex": "ccc"}, 5: {"s/a.tex": "a", "t/b.tex": "bb"}}[n % 6]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in (files | {"../evil.tex": "x", "/root.tex": "x", f"fig/{n}.PNG": "x", "fig/e.eps": "xx", "notes.txt": "x", "index.html": "h", "zz.html": "longer"}).items():
                z.writestr(zipfile.ZipInfo(name), text)
        return out.getvalue()

    return keys.map(one)


def _files(spark, d):
    """Members of all archives, stored once: what is asked of them is asked more than once."""
    return cut_lineage(inputs.extract(spread(_part(spark, d).select("doc_id")).select("doc_id", _zipped("doc_id").alias("content"))))


def archive_files(spark, d):
    """What archives hold: how many files, their images by stem, and no member that would leave the folder."""
    f = _files(spark, d)
    n = f.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.contains("path", F.lit("evil")).cast("int")).alias("evil"))
    images = inputs.image_inventory(f).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "stem", "extension", "size"))), "|").alias("images"))
    return n.join(images, "doc_id")


def main_files(spark, d):
    f = _files(spark, d)
    return inputs.main_tex(f).join(inputs.main_html(f).withColumnRenamed("main", "page"), "doc_id")


def cache_states(spark, d):
    """Which papers a cache still serves: its copies are as old as the rows, one in three has none."""
    p = table(spark, d, "papers").select("paper_id", T.cache_key(F.col("arxiv_id"), F.col("arxiv_version")).alias("cache_key"), F.concat(F.col("paper_id").cast("string"), F.lit("/k")).alias("k"))
    cache = table(spark, d, "papers").filter("paper_id % 3 > 0").select(F.concat(F.col("paper_id").cast("string"), F.lit("/k")).alias("k"), F.col("title").alias("content"), F.col("ingested_at").alias("fetched_at"))
    fresh, missing = inputs.through_cache(p, cache, 86400 * 200, F.lit("2024-12-31 00:00:00").cast("timestamp"), "k")
    return fresh.select("paper_id", "cache_key", F.lit(True).alias("fresh")).unionByName(missing.select("paper_id", "cache_key", F.lit(False).alias("fresh")))


def settings_values(spark, d):
    """Settings by layers: defaults, profile, user, environment, options."""
    s = S.load("test", {"output": {"scheme": "full-date"}, "cache": {"ttl_s": 7}}, {"QUIREWORK_HTTP__BACKOFF_S": "0.5", "QUIREWORK_CACHE__TTL_S": "9", "OTHER": "1"}, {"http": {"retries": None}, "images": {"dpi": 300}})
    rows = [(f"{a}.{b}", str(v)) for a, x in s.items() for b, v in x.items() if (a, b) in {("output", "anchors"), ("output", "scheme"), ("cache", "ttl_s"), ("http", "retries"), ("http", "backoff_s"), ("images", "dpi"), ("batch", "concurrency")}]
    return spark.createDataFrame(rows, "name string, value string")


# ---- metadata


def atom_records(spark, d):
    """Records of the feed, from XML made of papers; every ninth answer is broken."""
    text = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    p = table(spark, d, "papers")
    authors = F.array_join(F.transform(F.coalesce("authors", F.array()), lambda a: F.concat(F.lit("<author><name>"), text(a), F.lit("</name></author>"))), "")
    xml = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/'), "arxiv_id", F.lit("v3</id><title>"), text(F.col("title")), F.lit("\n  tail</title><published>2021-03-04T05:06:07Z</published>"), authors,
        F.lit('<arxiv:primary_category xmlns:arxiv="x" term="'), F.coalesce("primary_category", F.lit("none")), F.lit('"/><link title="doi" href="http://dx.doi.org/10.1/'), F.col("paper_id").cast("string"), F.lit('"/></entry></feed>'),
    )
    e = p.select("paper_id", M.atom_entry(F.when(F.col("paper_id") % 9 == 0, F.substring(xml, 1, 60)).otherwise(xml)).alias("e"))
    return e.select("paper_id", "e.arxiv_id", "e.version", "e.title", "e.submission_date", "e.primary_category", "e.doi", F.size(M.display_names(F.col("e.authors"))).alias("n_authors"))


def crossref_records(spark, d):
    """Records of the registry, from JSON made of citations; every ninth answer is broken."""
    c = table(spark, d, "citations")
    one = lambda x: F.array(x)
    message = F.struct(one(F.col("title")).alias("title"), one(F.col("journal")).alias("container-title"), "volume", "issue", F.col("pages").alias("page"), "publisher", F.col("doi").alias("DOI"), F.struct(one(F.array(F.lit(2020), F.lit(3))).alias("date-parts")).alias("published-print"),
        F.array(F.struct(F.lit("Ada").alias("given"), F.col("cite_key").alias("family"), F.lit("https://orcid.org/0000-0002-1825-009X").alias("ORCID"))).alias("author"))
    json = F.to_json(F.struct(message.alias("message")))
    r = c.select("citation_id", M.crossref_record(F.when(F.col("citation_id") % 9 == 0, F.lit("{")).otherwise(json)).alias("r"))
    return r.select("citation_id", "r.title", "r.publication_name", "r.volume", "r.pages", "r.publisher", "r.doi", "r.print_date", F.get("r.authors", F.lit(0))["name"].alias("author"), F.get("r.authors", F.lit(0))["orcid"].alias("orcid"))


def enriched_authors(spark, d):
    """Two authors a record, with what an abstract page's hint and the aggregator know of them: the second has a match."""
    p = _part(spark, d)
    none = F.expr("cast(array() as array<string>)")
    author = lambda n, o: F.struct(n.alias("name"), none.alias("affiliations"), F.lit(o).cast("string").alias("orcid"))
    meta = p.select(F.col("p_partkey").alias("arxiv_id"), F.array(author(F.concat(F.lit("Ada L. "), "x"), None), author(F.lit("Bob Q"), None)).alias("authors"))
    html = F.concat(F.lit('<div class="authors"><a>Ada</a><a>Bob</a></div><meta name="citation_author_institution" content="Hint '), "x", F.lit('"><span class="affiliation">hint '), F.lower("x"), F.lit("</span>"))
    abs_pages = A.abstract_page_rows(p.select("doc_id", html.alias("html"))).withColumnRenamed("doc_id", "arxiv_id")
    work = F.concat(F.lit('{"id": "W'), F.col("p_partkey").cast("string"), F.lit('", "authorships": [{"author": {"display_name": "'), "x", F.lit(', Ada", "orcid": "https://orcid.org/0000-0001-2345-678X"}, "institutions": [{"display_name": "Uni"}], "raw_affiliation_strings": ["Uni, City", "uni"]}]}'))
    got = M.enriched(meta, abs_pages, p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("arxiv_id"), work.alias("json")))
    show = F.array_join(F.transform("authors", lambda a: F.concat_ws("/", a["name"], F.array_join(a["affiliations"], "+"), a["orcid"])), ";")
    return got.select("arxiv_id", show.alias("authors"), "n_matched", "openalex_id")


def tex_affiliations(spark, d):
    """Affiliations from TeX for the authors of a record, switched on for all and off for a copy."""
    p = _part(spark, d)
    none = F.expr("cast(array() as array<string>)")
    author = lambda n, a: F.struct(n.alias("name"), a.alias("affiliations"), F.lit(None).cast("string").alias("orcid"))
    meta = p.select(F.col("p_partkey").alias("arxiv_id"), F.array(author(F.concat(F.lit("Ada "), "x"), F.array(F.lit("uni "), F.lit("Own"))), author(F.lit("Bob Q"), none)).alias("authors"))
    tex = p.select(F.col("p_partkey").alias("arxiv_id"), F.concat(F.lit(r"\author{Eve \\ Nowhere \and A. "), "x", F.lit(r" \\ Uni \and Nobody}")).alias("text"))
    show = F.array_join(F.transform("authors", lambda a: F.concat_ws("/", a["name"], F.array_join(a["affiliations"], "+"))), ";").alias("authors")
    on, off = M.with_tex_affiliations(meta, tex), M.with_tex_affiliations(meta, tex, enabled=False)
    return on.select("arxiv_id", F.lit("on").alias("mode"), show, "n_tex").unionByName(off.select("arxiv_id", F.lit("off").alias("mode"), show, "n_tex"))


def merged_records(spark, d):
    """API records with the registry's fields, keywords of both, and defaults by the id."""
    p = _part(spark, d)
    api = p.select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("doi"), F.format_string("%02d%02d.%05d", F.lit(21), F.pmod("p_size", F.lit(14)), F.col("p_partkey")).alias("arxiv_id"), F.col("p_name").alias("title"), F.lit("v0").alias("volume"), F.concat(F.lit("J "), "x").alias("journal_ref"),
        F.array(F.struct(F.concat(F.lit("Ada "), "x").alias("name"))).alias("authors"), F.array(F.lit("Alpha"), F.col("p_name")).alias("keywords"), F.lit(None).cast("string").alias("submission_date"))
    registry = p.filter("p_partkey % 2 = 0").select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("doi"), F.concat(F.lit("v"), F.col("p_size").cast("string")).alias("volume"), F.lit(None).cast("string").alias("publication_name"), F.array(F.lit("ALPHA"), F.lit("beta")).alias("subjects"))
    m = M.with_defaults(M.merged(api, registry))
    return m.select("arxiv_id", "volume", "publication_name", F.array_join("keywords", "|").alias("keywords"), "submission_date", "citation")


@F.pandas_udf(StringType())
def _yaml_round(texts: pd.Series) -> pd.Series:
    """A record written as YAML over an older one with a note of its own, read again: its id and the note."""
    import json

    def one(t: str) -> str:
        fresh = json.loads(t)
        old = {"identifiers": {"arxiv": "old", "note": "kept"}, "tags": ["a"]}
        again = yaml_files.load(yaml_files.dump(yaml_files.merge_keep(fresh, old)))
        return f"{yaml_files.paper_id(again)}|{again['identifiers']['note']}|{','.join(again['tags'])}|{again['title']}"

    return texts.map(one)


def record_yaml(spark, d):
    """Paper records as YAML, merged over older ones, and read again."""
    p = _part(spark, d).select(F.col("p_partkey").cast("string").alias("arxiv_id"), F.col("p_name").alias("title"), F.lit("journal-article").alias("type"), F.concat(F.lit("10.1/"), "x").alias("doi"), F.lit("").alias("print_date"), F.lit("2020-05").alias("online_date"), F.lit("20200101").alias("submission_date"))
    r = M.paper_record(p)
    return r.select("arxiv_id", F.get_json_object("record", "$.type").alias("type"), F.get_json_object("record", "$.date").alias("date"), F.get_json_object("record", "$.identifiers.doi").alias("doi"), _yaml_round("record").alias("read"))


def paper_citations(spark, d):
    """Short citations and BibTeX entries of records with none, one, two and three authors."""
    p = _part(spark, d)
    names = F.slice(F.array(F.concat(F.lit("Ada "), "x"), F.lit("Low, Bob"), F.lit("Cy Q")), F.lit(1), F.pmod("p_partkey", F.lit(4)).cast("int"))
    year, ident = F.lit("2021"), F.concat(F.lit("2101."), F.col("p_partkey").cast("string"), F.lit("v2"))
    return p.select("doc_id", T.short_citation(names, year, F.repeat("p_name", 6), ident).alias("citation"), T.paper_bibtex(names, year, F.concat(F.lit("{"), "p_name", F.lit("}")), ident, F.lit("cs.CL"), F.lit("")).alias("bibtex"))


def name_pairs(spark, d):
    """Whether names match: without full stops, by the last word, by the family name of a turned form, or not."""
    p = _part(spark, d)
    forms = [("A.B. ‹x›", "a b ‹x›"), ("Ada ‹x›", "Eve ‹x›"), ("‹x›, Ada", "Ada ‹x›"), ("Ada ‹x›", "‹x›, A."), ("Ada ‹x›", "‹x› Ada"), ("", "")]
    put = lambda t: F.concat(*[F.col("x") if k % 2 else F.lit(q) for k, q in enumerate(re.split("‹(x)›", t))])
    return p.select("doc_id", F.posexplode(F.array(*[T.names_match(put(a), put(b)) for a, b in forms])).alias("form", "same"))


def affiliation_sets(spark, d):
    """Affiliations of authors without those that a longer one holds, and ORCID iDs in addresses."""
    p = table(spark, d, "paper_authors").filter("affiliations is not null")
    longer = F.concat("affiliations", F.transform("affiliations", lambda a: F.concat(a, F.lit(", City"))), F.array(F.lit(" ")))
    return p.select("author_id", F.size(T.without_contained(longer)).alias("n"), T.orcid(F.concat(F.lit("https://orcid.org/0000-0000-0000-00"), F.lpad(F.pmod("author_id", F.lit(90)).cast("string"), 2, "0"))).alias("orcid"))


def affiliations_of_names(spark, d):
    """Names with the API's affiliations, else the page's, without regard to case and accents."""
    p = _part(spark, d)
    names = p.select("doc_id", F.posexplode(F.array(F.concat(F.lit("Ádá "), "x"), F.lit("Bob"), F.lit("Eve"))).alias("ord", "name"))
    api = p.select("doc_id", F.lit(0).alias("ord"), F.upper(F.concat(F.lit("Ada "), "x")).alias("name"), F.array("p_name").alias("affiliations"))
    html = p.select("doc_id", F.posexplode(F.array(F.concat(F.lit("Ada "), "x"), F.lit("bób"))).alias("ord", "name")).withColumn("affiliations", F.array(F.lit("page")))
    return M.affiliations_by_name(names, api, html).select("doc_id", "ord", F.array_join("affiliations", "|").alias("affiliations"))


# ---- images


def image_files(spark, d):
    """References of TeX to an archive's files: by path, stem, stem in another case, number, name, a word of the name, or none; logos in titles don't count."""
    p = _part(spark, d)
    refs = ["fig/a.png", "b", "C", "x2.png", "other/d.JPG", "plot‹x›", "none"]
    put = lambda t: F.concat(*[F.col("x") if k % 2 else F.lit(q) for k, q in enumerate(re.split("‹(x)›", t))])
    tex = F.concat(F.lit(r"\title{T \includegraphics{logo}}"), *[put(r"\includegraphics[width=1cm]{" + r + "}\n") for r in refs], F.lit("% \\includegraphics{no}"))
    files = p.select("doc_id", F.explode(F.array(*[put(f) for f in ("fig/a.png", "img/b.pdf", "img/c.eps", "d.jpg", "zz/my-plot‹x›-v2.png")])).alias("path"))
    found = I.image_references(p.select("doc_id", tex.alias("text")), titles=True)
    return I.resolve(found, files).select("doc_id", F.col("ord").cast("long").alias("ord"), "src", "rank")


def figure_images(spark, d):
    """Only images inside figure environments."""
    tex = F.concat(F.lit("\\includegraphics{out}\\begin{figure*}\\includegraphics{"), "x", F.lit("}\\begin{overpic}[a]{o}\\end{overpic}\\end{figure*}\\includegraphics{after}"))
    return I.image_references(_part(spark, d).select("doc_id", tex.alias("text")), in_figures=True).select("doc_id", F.col("ord").cast("long").alias("ord"), "ref")


def image_copies(spark, d):
    """Copied images with flat names, through a converter that fails on every fourth."""
    p = _part(spark, d)
    files = p.select("doc_id", F.explode(F.array(F.lit("a/x.png"), F.lit("b/x.png"), F.concat("x", F.lit(".jpg")))).alias("path")).withColumn("content", F.encode("path", "utf-8"))

    def maker():
        def convert(path, content):
            if path.startswith("b/"):
                raise ValueError(path)
            return path + ".out", content[::-1]

        return convert

    done = I.convert_images(files, maker)
    return I.copied_names(files).select("doc_id", "path", "copy").join(done.select("doc_id", "path", "new_path", F.decode("content", "utf-8").alias("content"), "error"), ["doc_id", "path"])


def panel_images(spark, d):
    """Figures without a match take the images that are left, as many as they have panels; the images' order is by stem, then number."""
    p = _part(spark, d)
    found = p.select("doc_id", F.explode(F.array(*[F.struct(F.lit(s).cast("string").alias("stem"), F.lit(n).alias("index"), f.alias("path")) for s, n, f in (("b", 9, F.lit("b.png")), (None, 2, F.lit("two.png")), (None, 1, F.col("x")), ("a", 5, F.lit("a.png")))])).alias("i")).select("doc_id", "i.*")
    ordered = I.in_order(found).select("doc_id", (F.col("n") - 1).alias("index"), "path")
    figures = p.select("doc_id", F.explode(F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(n).alias("panels")) for o, n in ((0, 1), (1, 2), (2, 2))])).alias("f")).select("doc_id", "f.*")
    return I.consume_by_index(figures, ordered)


def asset_lists(spark, d):
    """Assets of a document in order and by stem; of equal stems the last one counts."""
    p = _part(spark, d)
    rows = F.array(*[F.struct(F.lit(k).alias("pos"), f.alias("path"), F.lit("b").alias("stem")) for k, f in enumerate((F.lit("b.png"), F.lit("b.png"), F.col("x")))])
    a = G.asset_list(p.select("doc_id", F.explode(rows).alias("i")).select("doc_id", "i.*", F.lit("image").alias("kind")))
    return a.select("doc_id", F.array_join("assets.path", "|").alias("paths"), F.col("stems")["b"].alias("b"))


# ---- citations


def bib_pages(spark, d):
    """Bibliographies of pages resolved by DOI, by arXiv id and from the text, as BibTeX with keys of their own."""
    html = (
        '<section class="ltx_bibliography"><ul><li id="bib.bib7">Low ‹name›. 10.1000/d‹key›.</li><li>Low, A. arXiv:2101.‹key›0000v2</li><li>Plain ‹name›, 1999. ' + "word " * 30 + "</li></ul></section>"
    )
    found = C.from_pages(parts(spark, d, html=html))
    p = _part(spark, d)
    record = lambda t: F.struct(t.alias("title"), F.array(F.lit("Ada Low")).alias("authors"), F.lit("2001").alias("year"), F.lit("J & K").alias("journal"))
    dois = p.select(F.concat(F.lit("10.1000/D"), F.col("p_partkey").cast("string")).alias("id"), record(F.concat(F.lit("By DOI "), "p_name")).alias("record"))
    arxiv = p.select(F.concat(F.lit("2101."), F.col("p_partkey").cast("string"), F.lit("0000")).alias("id"), record(F.lit("By id")).alias("record"))
    r = C.resolve(found, dois, arxiv)
    return r.select("doc_id", "ord", F.col("key").alias("source_key"), "resolved_by").join(C.bibtex(r, "doc_id"), ["doc_id", "ord"])


def cited_pages(spark, d):
    """Pages without a bibliography: every citation is an entry."""
    return C.from_pages(parts(spark, d, html="<p><cite>[‹name›]</cite> and <cite> </cite><cite>x ‹key›</cite></p>")).select("doc_id", "ord", "key", "text")


def bibtex_escapes(spark, d):
    """Special characters of BibTeX, each between a row's words."""
    return _part(spark, d).select("doc_id", T.bibtex_escape(F.concat(*[x for c in "\\{}&%$#_^~" for x in (F.col("p_name"), F.lit(c))])).alias("text"))


# ---- anchors, nodes, outputs


def unique_anchors(spark, d):
    """Anchors whose bases clash with made ones."""
    bases = F.array(*map(F.lit, ["a", "a", "a-2", "a-2-2", "a-2", "a"]), "p_name", F.lit(None))
    b = _part(spark, d).select("doc_id", F.posexplode(bases).alias("pos", "base"))
    return N.unique_anchors(b).select("doc_id", "pos", "anchor")


def visited_nodes(spark, d):
    """A rule for each kind of node, a default for the others, and the texts in order."""
    tree = traverse.nodes(P.parse_pages(parts(spark, d, html=page(section("<p>one <em>‹name›</em></p><p>two ‹size›</p>")))))
    seen = traverse.visit(tree, {"section": F.concat(F.lit("S:"), "text"), "paragraph": F.concat(F.lit("P:"), "text")}, F.lit("-"))
    values = seen.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("place", "value")))["value"], "|").alias("visits"))
    return values.join(traverse.texts(tree).select("doc_id", F.array_join("texts", "|").alias("texts")), "doc_id")


def token_summaries(spark, d):
    """Summaries with a token count, and what a run prints with and without the tree."""
    t = PL.convert(parts(spark, d, html=page(section("<p>x</p>"))))
    s = PL.summary(t, table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") * 1000).alias("tokens")))
    text = T.joined_output(F.col("summary"), F.col("sections_tree"), F.lit("body"))
    return s.select("doc_id", text.alias("printed"), T.joined_output(F.col("summary"), F.col("sections_tree"), F.lit(None).cast("string"), False).alias("short"))


def written_files(spark, d):
    """Markdown parts as files, read back; a part that is absent leaves none."""
    made = parts(spark, d, content="main ‹name›", refs="refs ‹key›")
    out = f"{shared_folder(spark)}/quirework-written-{d.strip('/').replace('/', '-')}"
    rows = made.withColumn("doc_id", F.pmod("doc_id", F.lit(7))).groupBy("doc_id").agg(F.max("content").alias("content"), F.max(F.when(F.col("doc_id") > 2, F.col("refs"))).alias("content_references"), F.lit(None).cast("string").alias("content_appendix"))
    sinks.write_markdown(rows, out)
    return spark.read.schema("value string, doc_id long, part string").text(out, wholetext=True)


def batch_outcomes(spark, d):
    """A batch of all papers' lines through the router, the fetcher, the reader and the writers: status, error and content of each."""
    p = table(spark, d, "papers")
    line = F.when(F.col("paper_id") % 10 == 0, F.lit("# note")).when(F.col("paper_id") % 10 == 1, F.lit(" ")).when(F.col("paper_id") % 10 == 2, F.lit("no id")).when(F.col("paper_id") % 10 == 3, F.lit("/nowhere/at/all.html")).otherwise(F.concat(F.lit("2101."), F.lpad(F.col("paper_id").cast("string"), 5, "0")))
    lines = inputs.classify(p.select(F.col("paper_id").alias("n"), line.alias("line")))
    documents, outcomes = batch.run_batch(lines, make_fetcher=_Server, tries=2, backoff_s=0.0)
    return outcomes.join(documents.select(F.col("doc_id").alias("n"), "title", "content"), "n", "left").select("n", "status", "error", batch.error_class(F.col("error")).alias("error_class"), "title", "content")


QUERIES = [
    input_kinds, page_fetch, tex_fetch, placeholder_pages, archive_files, main_files, cache_states, settings_values, atom_records, crossref_records, enriched_authors, tex_affiliations, merged_records, record_yaml, paper_citations, name_pairs,
    affiliation_sets, affiliations_of_names, image_files, figure_images, image_copies, panel_images, asset_lists, bib_pages, cited_pages, bibtex_escapes, unique_anchors, visited_nodes, token_summaries, written_files, batch_outcomes,
]

_WS = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_N = f"n AS (SELECT *, p_partkey AS doc_id, {_X} AS x FROM part)"


def _forms(rows: list[tuple], columns: str) -> str:
    """The same rows for each part: values are SQL over n."""
    return f"WITH {_N} " + " UNION ALL ".join(f"SELECT doc_id, {', '.join(f'{v} AS {c}' for v, c in zip(r, columns.split()))} FROM n" for r in rows)


def sql() -> dict[str, str]:
    kinds = ["'local_html'", "'local_html'", "'local_archive'", "'local_archive'", "'local_archive'", "CASE WHEN length(p_partkey::VARCHAR) IN (4, 5) THEN 'arxiv' ELSE 'unknown' END", "'skip'", "'skip'", "'unknown'", "'unknown'"]
    refs = [("'fig/a.png'", 1), ("'img/b.pdf'", 2), ("'img/c.eps'", 3), ("'fig/a.png'", 4), ("'d.jpg'", 2), ("'zz/my-plot' || x || '-v2.png'", 6), ("'none'", "NULL")]
    anchors = ["'a'", "'a-2'", "'a-2-2'", "'a-2-2-2'", "'a-2-3'", "'a-3'", "p_name", "NULL"]
    return {
        "input_kinds": _forms([(k, v) for k, v in enumerate(kinds)], "form kind"),
        "page_fetch": """
            SELECT paper_id, CASE WHEN paper_id % 7 IN (1, 2) THEN 'ar5iv' ELSE 'html' END AS "at", CASE WHEN paper_id % 7 IN (0, 1, 6) THEN paper_id || '' END AS read,
            CASE paper_id % 7 WHEN 2 THEN 'not found' WHEN 3 THEN 'no page for this source' WHEN 4 THEN 'content type application/pdf' WHEN 5 THEN 'status 403' END AS error FROM papers""",
        "tex_fetch": "SELECT paper_id, CASE WHEN paper_id % 5 IN (0, 4) THEN 'tar ' || paper_id END AS content, CASE WHEN paper_id % 5 IN (1, 2, 3) THEN 'not found' END AS error FROM papers",
        "placeholder_pages": _forms([(0, "TRUE"), (1, "FALSE"), (2, "FALSE")], "form refused"),
        "archive_files": f"WITH {_N} SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 6 WHEN 4 THEN 8 ELSE 7 END AS n, 0 AS evil, doc_id || ':png:1|e:eps:2' AS images FROM n",
        "main_files": f"WITH {_N} SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'only/x.tex' WHEN 1 THEN 'root.tex' WHEN 2 THEN 'paper.tex' WHEN 3 THEN '2101.00001.tex' WHEN 4 THEN 'b.tex' ELSE 't/b.tex' END AS main, 'index.html' AS page FROM n",
        "cache_states": """
            SELECT paper_id, replace(arxiv_id || '__' || coalesce(arxiv_version, 'latest'), '/', '_') AS cache_key,
            paper_id % 3 > 0 AND coalesce(floor(epoch(TIMESTAMP '2024-12-31 00:00:00')) - floor(epoch(ingested_at)) <= 86400 * 200, FALSE) AS fresh FROM papers""",
        "settings_values": "SELECT * FROM (VALUES ('output.anchors', 'True'), ('output.scheme', 'full-date'), ('cache.ttl_s', '9'), ('http.retries', '1'), ('http.backoff_s', '0.5'), ('images.dpi', '300'), ('batch.concurrency', '3')) v(name, value)",
        "atom_records": f"""
            WITH p AS (SELECT *, paper_id % 9 > 0 AS good FROM papers)
            SELECT paper_id, CASE WHEN good THEN arxiv_id END AS arxiv_id, CASE WHEN good THEN 'v3' END AS version, CASE WHEN good THEN trim(regexp_replace(concat(title, ' tail'), '{_WS}', ' ', 'g')) END AS title,
            CASE WHEN good THEN '20210304' END AS submission_date, CASE WHEN good THEN coalesce(primary_category, 'none') END AS primary_category, CASE WHEN good THEN '10.1/' || paper_id END AS doi,
            CASE WHEN good AND len(authors) > 0 THEN len(list_filter(authors, lambda a: trim(a) <> '')) END::INT AS n_authors FROM p""",
        "crossref_records": """
            WITH c AS (SELECT *, citation_id % 9 > 0 AS good FROM citations)
            SELECT citation_id, CASE WHEN good THEN title END AS title, CASE WHEN good THEN journal END AS publication_name, CASE WHEN good THEN volume END AS volume, CASE WHEN good THEN pages END AS pages, CASE WHEN good THEN publisher END AS publisher,
            CASE WHEN good THEN lower(doi) END AS doi, CASE WHEN good THEN '2020-03' END AS print_date, CASE WHEN good THEN concat_ws(' ', 'Ada', cite_key) END AS author, CASE WHEN good THEN '0000-0002-1825-009X' END AS orcid FROM c""",
        "enriched_authors": f"""
            WITH {_N} SELECT doc_id AS arxiv_id, 'Ada L. ' || x || '/Hint ' || x || CASE WHEN doc_id % 2 = 0 THEN '+Uni, City/0000-0001-2345-678X' ELSE '' END || ';Bob Q/Hint ' || x AS authors,
            CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS n_matched, CASE WHEN doc_id % 2 = 0 THEN 'W' || doc_id END AS openalex_id FROM n""",
        "tex_affiliations": f"WITH {_N} SELECT doc_id AS arxiv_id, 'on' AS mode, 'Ada ' || x || '/uni+Own;Bob Q/' AS authors, 1 AS n_tex FROM n UNION ALL SELECT doc_id, 'off', 'Ada ' || x || '/uni +Own;Bob Q/', 0 FROM n",
        "merged_records": f"""
            WITH {_N}, m AS (SELECT *, '21' || lpad((p_size % 14) || '', 2, '0') || '.' || lpad(doc_id || '', 5, '0') AS a, p_size % 14 BETWEEN 1 AND 12 AS dated FROM n)
            SELECT a AS arxiv_id, CASE WHEN doc_id % 2 = 0 THEN 'v' || p_size ELSE 'v0' END AS volume, 'J ' || x AS publication_name, 'Alpha|' || p_name || CASE WHEN doc_id % 2 = 0 THEN '|beta' ELSE '' END AS keywords,
            CASE WHEN dated THEN '20' || left(a, 4) || '01' END AS submission_date, 'Ada ' || x || CASE WHEN dated THEN '. (2021)' ELSE '' END || '. ' || p_name || '. arXiv:' || a || '.' AS citation FROM m""",
        "record_yaml": f"WITH {_N} SELECT doc_id || '' AS arxiv_id, 'article' AS type, '2020-05' AS date, '10.1/' || x AS doi, doc_id || '|kept|a|' || p_name AS read FROM n",
        "paper_citations": f"""
            WITH {_N}, t AS (SELECT *, repeat(p_name, 6) AS t, doc_id % 4 AS k FROM n)
            SELECT doc_id, CASE k WHEN 0 THEN '' ELSE CASE k WHEN 1 THEN 'Ada ' || x WHEN 2 THEN 'Ada ' || x || ' and Low, Bob' ELSE 'Ada ' || x || ' et al.' END || '. (2021). ' || CASE WHEN length(t) > 60 THEN left(t, 57) || '...' ELSE t END || '. arXiv:2101.' || doc_id || 'v2.' END AS citation,
            CASE k WHEN 0 THEN '' ELSE concat('@misc{{', lower(x), '20212101,', chr(10), '  author = {{', x, ', Ada', CASE WHEN k > 1 THEN ' and Low, Bob' ELSE '' END, CASE WHEN k > 2 THEN ' and Q, Cy' ELSE '' END, '}},', chr(10), '  title = {{{{{{', p_name, '}}}}}},', chr(10), '  year = {{2021}},', chr(10),
              '  eprint = {{2101.', doc_id, '}},', chr(10), '  archivePrefix = {{arXiv}},', chr(10), '  primaryClass = {{cs.CL}},', chr(10), '}}') END AS bibtex FROM t""",
        "name_pairs": _forms([(k, "TRUE" if k < 4 else "FALSE") for k in range(6)], "form same"),
        "affiliation_sets": f"""
            WITH a AS (SELECT author_id, unnest(list_concat(affiliations, list_transform(affiliations, lambda x: x || ', City'))) AS t FROM paper_authors WHERE affiliations IS NOT NULL),
            u AS (SELECT DISTINCT author_id, lower(regexp_replace(t, '^{_WS}|{_WS}$', '', 'g')) AS t FROM a WHERE t IS NOT NULL AND regexp_replace(t, '^{_WS}|{_WS}$', '', 'g') <> ''),
            k AS (SELECT author_id, count(*) AS n FROM u WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.author_id = u.author_id AND length(v.t) > length(u.t) AND contains(v.t, u.t)) GROUP BY author_id)
            SELECT p.author_id, coalesce(k.n, 0)::INT AS n, '0000-0000-0000-00' || lpad((p.author_id % 90) || '', 2, '0') AS orcid FROM paper_authors p LEFT JOIN k ON k.author_id = p.author_id WHERE p.affiliations IS NOT NULL""",
        "affiliations_of_names": _forms([(0, "p_name"), (1, "'page'"), (2, "''")], "ord affiliations"),
        "image_files": _forms([(f"{k}::BIGINT", s, r) for k, (s, r) in enumerate(refs)], "ord src rank"),
        "figure_images": _forms([("0::BIGINT", "x"), ("1::BIGINT", "'o'")], "ord ref"),
        "image_copies": _forms([("'a/x.png'", "'x.png'", "'a/x.png.out'", "'gnp.x/a'", "NULL"), ("'b/x.png'", "'x_1.png'", "NULL", "NULL", "'ValueError: b/x.png'"), ("x || '.jpg'", "x || '.jpg'", "x || '.jpg.out'", "reverse(x || '.jpg')", "NULL")], "path copy new_path content error"),
        "panel_images": _forms([(0, 0, "'a.png'"), (1, 0, "'b.png'"), (1, 1, "x"), (2, 0, "'two.png'"), (2, 1, "NULL")], "ord panel path"),
        "asset_lists": f"WITH {_N} SELECT doc_id, 'b.png|' || x AS paths, x AS b FROM n",
        "bib_pages": f"""
            WITH {_N}, r AS (SELECT doc_id, 0 AS ord, 'bib7' AS source_key, 'doi' AS resolved_by, 'low2001' AS key, 'By DOI ' || p_name AS t, TRUE AS known FROM n
            UNION ALL SELECT doc_id, 1, 'bib2', 'arxiv', 'low20011', 'By id', TRUE FROM n UNION ALL SELECT doc_id, 2, 'bib3', 'text', '1999plain', left('Plain ' || p_name || ', 1999. ' || repeat('word ', 30), 100) || '...', FALSE FROM n)
            SELECT doc_id, ord, source_key, resolved_by, key, CASE WHEN known THEN concat('@article{{', key, ',', chr(10), '  title = {{', t, '}},', chr(10), '  author = {{Low, Ada}},', chr(10), '  year = {{2001}},', chr(10), '  journal = {{J \\& K}}', chr(10), '}}')
            ELSE concat('@misc{{', key, ',', chr(10), '  title = {{', t, '}},', chr(10), '  year = {{1999}}', chr(10), '}}') END AS entry FROM r""",
        "cited_pages": _forms([(0, "'cite1'", "'[' || p_name || ']'"), (1, "'cite3'", "'x ' || p_partkey")], "ord key text"),
        "bibtex_escapes": f"WITH {_N} SELECT doc_id, " + " || ".join(f"p_name || '{e}'" for e in ("\\textbackslash\\{\\}", "\\{", "\\}", "\\&", "\\%", "\\$", "\\#", "\\_", "\\^{}", "\\textasciitilde{}")) + " AS text FROM n",
        "unique_anchors": _forms([(k, a) for k, a in enumerate(anchors)], "pos anchor"),
        "visited_nodes": f"WITH {_N} SELECT doc_id, '-|-|S:Head ' || doc_id || '|P:one ' || p_name || '|-|-|-|P:two ' || p_size || '|-' AS visits, 'one |' || p_name || '|two ' || p_size AS texts FROM n",
        "token_summaries": f"""
            WITH {_N}, s AS (SELECT doc_id, concat('Title: Title ', doc_id, chr(10), 'Sections: 1', chr(10), 'Estimated tokens: ', p_size, '.0k') AS short FROM n)
            SELECT doc_id, concat(short, chr(10), chr(10), 'Head ', doc_id, chr(10), chr(10), 'body') AS printed, short FROM s""",
        "written_files": """
            SELECT 'paper' AS part, p_partkey % 7 AS doc_id, 'main ' || max(p_name) || chr(10) AS value FROM part GROUP BY ALL
            UNION ALL SELECT 'references', p_partkey % 7, 'refs ' || max(p_partkey || '') || chr(10) FROM part WHERE p_partkey % 7 > 2 GROUP BY ALL""",
        "batch_outcomes": """
            WITH p AS (SELECT paper_id AS n, CASE WHEN paper_id % 10 IN (0, 1) THEN 'skip' WHEN paper_id % 10 = 2 THEN 'UserInputError: neither an arXiv id nor a page or archive' WHEN paper_id % 10 = 3 THEN 'StorageError: FileNotFoundError'
              WHEN paper_id % 7 IN (1, 2) THEN 'NetworkError: not found' WHEN paper_id % 7 = 3 THEN 'NetworkError: no page for this source' WHEN paper_id % 7 = 4 THEN 'NetworkError: content type application/pdf' WHEN paper_id % 7 = 5 THEN 'NetworkError: status 403' ELSE 'ok' END AS e FROM papers)
            SELECT n, CASE WHEN e IN ('skip', 'ok') THEN e ELSE 'error' END AS status, CASE WHEN e NOT IN ('skip', 'ok') THEN e END AS error, CASE WHEN e NOT IN ('skip', 'ok') THEN split_part(e, ':', 1) END AS error_class,
            CASE e WHEN 'ok' THEN 'Title ' || n END AS title, CASE e WHEN 'ok' THEN concat('## Head ', n, chr(10), chr(10), 'text of ', n, chr(10)) END AS content FROM p""",
    }
