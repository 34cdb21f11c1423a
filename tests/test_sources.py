import gzip
import io
import json
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quirework import settings as S
from quirework.operators import citations as C
from quirework.operators import images as I
from quirework.operators import metadata as M
from quirework.sources import inputs, yaml_files

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def archive(kind):
    b = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(b, "w") as z:
            z.writestr("a/main.tex", "x"), z.writestr("../evil", "y")
    else:
        with tarfile.open(fileobj=b, mode="w:gz") as t:
            for n in ("main.tex", "../evil"):
                i = tarfile.TarInfo(n)
                i.size = 1
                t.addfile(i, io.BytesIO(b"x"))
    return b.getvalue()


def test_archives(spark):
    rows = [(1, archive("zip")), (2, archive("tar")), (3, gzip.compress(b"only")), (4, b"%PDF-1.4"), (5, None), (6, b"PKbroken")]
    got = {(r.doc_id, r.path): bytes(r.content) for r in inputs.extract(spark.createDataFrame(rows, "doc_id int, content binary")).collect()}
    assert got == {(1, "a/main.tex"): b"x", (2, "main.tex"): b"x", (3, "main.tex"): b"only"}


def test_main_files(spark):
    rows = [(1, "x/a.tex", b"aa", 2), (1, "main.tex", b"a", 1), (2, "only.tex", b"", 0), (3, "b.tex", b"\\documentclass\\begin{document}", 9), (3, "c.tex", b"long" * 9, 36), (4, "index.html", b"", 0), (4, "big.html", b"x", 5)]
    f = spark.createDataFrame(rows, "doc_id int, path string, content binary, size int")
    assert {r.doc_id: r.main for r in inputs.main_tex(f).collect()} == {1: "main.tex", 2: "only.tex", 3: "b.tex"}
    # a usual name counts in the root only
    sub = [(5, "supp/main.tex", b"aaaa", 4), (5, "z.tex", b"\\documentclass\\begin{document}", 9)]
    assert inputs.main_tex(spark.createDataFrame(sub, "doc_id int, path string, content binary, size int")).first().main == "z.tex"
    assert inputs.main_html(f).first().main == "index.html"


def test_retries():
    calls = []

    def fetch(url):
        calls.append(url)
        if len(calls) < 3:
            return 503, "", b""
        return 200, "text/html", b"<p>"

    waits = []
    assert inputs.fetch_with_retries(fetch, "u", 3, 2.0, waits.append)[3] is None and waits == [2.0, 4.0]
    assert inputs.fetch_with_retries(lambda u: (404, "", b""), "u", wait=waits.append)[3] == "not found"
    assert inputs.fetch_with_retries(lambda u: 1 / 0, "u", 2, wait=waits.append)[3].startswith("ZeroDivisionError")


def test_fetch_and_cache(spark):
    def maker():
        return lambda url: (200, "text/html", b"<p>" + url.encode()) if "good" in url else (404, "", b"")

    df = spark.createDataFrame([("a", "bad", "good"), ("b", "bad", "bad"), ("c", None, None)], "id string, html_url string, ar5iv_url string")
    got = {r.id: (r.html, r.error) for r in inputs.fetch_pages(df, maker, tries=1).collect()}
    assert got == {"a": ("<p>good", None), "b": (None, "not found"), "c": (None, "no address")}
    cache = spark.sql("select 'k' cache_key, 'c' content, timestamp'2024-01-01' fetched_at")
    fresh, missing = inputs.through_cache(spark.createDataFrame([("k",), ("l",)], "cache_key string"), cache, 0)
    assert [r.cache_key for r in fresh.collect()] == ["k"] and [r.cache_key for r in missing.collect()] == ["l"]


def test_files_and_records(spark):
    class Server:
        def __call__(self, url):
            return {"p": (200, "application/pdf", b"%PDF-1"), "t": (200, "application/gzip", b"tar"), "m": (200, "application/gzip", b"%PDF-1"), "r": (200, "text/xml", "é".encode())}.get(url, (500, "", b""))

    df = spark.createDataFrame([(1, "p"), (2, "t"), (3, "m"), (4, "x"), (5, None)], "id int, url string")
    got = {r.id: (bytes(r.content) if r.content else None, r.error) for r in inputs.fetch_files(df, Server, tries=2, backoff_s=0.0, tex=True).collect()}
    assert got == {1: (None, "not found"), 2: (b"tar", None), 3: (None, "not found"), 4: (None, "status 500"), 5: (None, "no address")}
    assert {r.id for r in inputs.fetch_files(df, Server, tries=1, backoff_s=0.0).filter("error is null").collect()} == {1, 2, 3}
    records = inputs.fetch_records(spark.createDataFrame([(1, "r"), (2, "x"), (3, None)], "id int, url string"), Server, tries=1)
    assert {r.id: r.body for r in records.collect()} == {1: "é", 2: None, 3: None}
    u = spark.range(1).select(inputs.record_urls(F.lit("2101.00001v2"), F.lit("doi:10.1/x")).alias("u")).first().u
    assert u.crossref.endswith("/works/10.1/x") and u.openalex.endswith("arXiv.2101.00001") and u.atom.endswith("=2101.00001v2")


def test_yaml():
    r = {"id": "arxiv:2101.1", "identifiers": {"doi": "x"}, "tags": ["a", "b"]}
    assert yaml_files.load(yaml_files.dump(r)) == r and yaml_files.paper_id(r) == "2101.1"
    assert yaml_files.merge_keep({"a": {"b": 1}}, {"a": {"b": 0, "c": 2}, "d": 3}) == {"a": {"b": 1, "c": 2}, "d": 3}


def test_settings():
    s = S.load(env={"QUIREWORK_OUTPUT__ANCHORS": "true", "QUIREWORK_HTTP__RETRIES": "5"}, options={"http": {"retries": None}})
    assert s["output"]["anchors"] is True and s["http"]["retries"] == 5
    assert S.load("test", env={})["cache"]["ttl_s"] == 0
    with pytest.raises(S.SettingsError):
        S.load(env={}, options={"http": {"retries": 99}})


def test_image_resolution(spark):
    t = spark.createDataFrame([(1, "\\includegraphics{figs/One}\n%\\includegraphics{no}\n\\includegraphics{x2.png}\\begin{overpic}{gone}"), (2, None)], "doc_id int, text string")
    refs = I.image_references(t)
    files = spark.createDataFrame([(1, "figs/one.pdf"), (1, "zz.png")], "doc_id int, path string")
    got = {r.ref: (r.src, r["rank"]) for r in I.resolve(refs, files).collect()}
    assert got == {"figs/One": ("figs/one.pdf", 3), "x2.png": ("zz.png", 4), "gone": ("gone", None)}
    figs = spark.createDataFrame([(1, 0, 2), (1, 1, 1)], "doc_id int, ord int, panels int")
    imgs = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id int, index int, path string")
    assert [r.path for r in I.consume_by_index(figs, imgs).orderBy("ord", "panel").collect()] == ["a", "b", None]
    assert I.without_titles("\\title{a {b}}c\\titlepage{d}") == " " * 13 + "c\\titlepage{d}"
    names = spark.createDataFrame([(1, "a/x.png"), (1, "b/x.png")], "doc_id int, path string")
    assert sorted(r.copy for r in I.copied_names(names).collect()) == ["x.png", "x_1.png"]
    bad = I.convert_images(spark.createDataFrame([(1, "a", b"x")], "doc_id int, path string, content binary"), lambda: lambda p, c: 1 / 0).first()
    assert bad.error.startswith("ZeroDivisionError")


def test_citations(spark):
    html = '<section class="ltx_bibliography"><ul><li id="bib.bib1">Doe. 10.1000/x.</li><li>Roe 1999</li></ul></section>'
    c = C.from_pages(spark.createDataFrame([(1, html), (2, "<cite>[A]</cite>"), (3, None)], "doc_id int, html string"))
    assert [(r.doc_id, r.key) for r in c.orderBy("doc_id", "ord").collect()] == [(1, "bib1"), (1, "bib2"), (2, "cite1")]
    rec = "id string, record struct<title:string,authors:array<string>,year:string,journal:string>"
    dois = spark.createDataFrame([("10.1000/X", ("T", ["Jane Doe"], "2001", "J"))], rec)
    r = {x.key: x for x in C.resolve(c, dois, spark.createDataFrame([], rec)).collect()}
    assert (r["bib1"].title, r["bib1"].resolved_by) == ("T", "doi") and (r["bib2"].year, r["bib2"].entry_type) == ("1999", "misc")
    assert C.bibtex(C.resolve(c, dois, spark.createDataFrame([], rec)), "doc_id").filter("key = 'doe2001'").count() == 1
    t = C.from_text(spark.createDataFrame([(1, "lead\nDoe, J. One\ncont\n[2] Two"), (2, None), (3, "")], "doc_id int, text string"))
    assert [x.text for x in t.orderBy("ord").collect()] == ["lead", "Doe, J. One cont", "[2] Two"]


def test_metadata(spark):
    xml = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2101.00001v2</id><title>A\n B</title><summary>S</summary><published>2021-01-02T00:00:00Z</published><author><name>Jane Doe</name></author><arxiv:doi>10.1/x</arxiv:doi><arxiv:primary_category term="cs.CL"/><category term="cs.CL"/></entry></feed>'
    one = spark.createDataFrame([(xml,), ("junk",), (None,)], "x string")
    got = one.select(M.atom_entry(F.col("x")).alias("e")).collect()
    e = got[0].e
    assert (e.arxiv_id, e.version, e.title, e.submission_date, e.doi, e.primary_category, e.authors[0].name) == ("2101.00001", "v2", "A B", "20210102", "10.1/x", "cs.CL", "Jane Doe")
    assert got[1].e.title is None and got[2].e.title is None
    cr = json.dumps({"message": {"title": ["T"], "container-title": ["J"], "author": [{"given": "Jane", "family": "Doe", "ORCID": "http://orcid.org/0000-0001-2345-678X"}], "published-print": {"date-parts": [[2020, 3]]}}})
    r = spark.createDataFrame([(cr,)], "x string").select(M.crossref_record(F.col("x")).alias("r")).first().r
    assert (r.title, r.publication_name, r.authors[0].name, r.authors[0].orcid, r.print_date) == ("T", "J", "Jane Doe", "0000-0001-2345-678X", "20-03") or r.print_date == "2020-03"
    authors = spark.createDataFrame([(1, 0, "Jane Doe", ["X"]), (1, 1, "Max", None)], "doc_id int, ord int, name string, affiliations array<string>")
    cand = spark.createDataFrame([(1, 0, "J. Doe", []), (1, 1, "Doe, Jane", ["MIT", "x"])], "doc_id int, ord int, name string, affiliations array<string>")
    m = {x.ord: (x.affiliations, x.matched) for x in M.merge_affiliations(authors, cand).collect()}
    assert m == {0: (["X", "MIT"], True), 1: (None, False)}
    api = spark.createDataFrame([("d", "v0", "J0", ["a"])], "doi string, volume string, journal_ref string, keywords array<string>")
    reg = spark.createDataFrame([("d", "v1", None, ["A", "b"])], "doi string, volume string, publication_name string, subjects array<string>")
    x = M.merged(api, reg).first()
    assert (x.volume, x.publication_name, x.keywords) == ("v1", "J0", ["a", "b"])


def test_archive_files_reads_archives_once(spark):
    from quirework.plans import source_queries as Q

    if os.path.isdir(DATA):
        plan = Q.archive_files(spark, DATA)._jdf.queryExecution().toString()
        assert "MapIn" not in plan and "ArrowEvalPython" not in plan
    # members of many archives, and of one that is larger than a batch
    many = b"".join(b"x" for _ in range(inputs.BATCH_ROWS + 5))
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n in range(inputs.BATCH_ROWS + 5):
            z.writestr(zipfile.ZipInfo(f"{n}.txt"), many[n : n + 1])
    rows = [(1, archive("zip")), (2, b.getvalue()), (3, None), (4, archive("tar"))]
    got = inputs.extract(spark.createDataFrame(rows, "doc_id int, content binary").coalesce(1)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    assert {(r.doc_id, r.n, r.s) for r in got.collect()} == {(1, 1, 1), (2, len(many), len(many)), (4, 1, 1)}


def test_main_files_keeps_contents_in_their_rows(spark):
    f = spark.createDataFrame([(1, "a.tex", b"x", 1), (1, "b/c.tex", b"xx", 2), (2, "2101.00001.tex", b"", 0)], "doc_id int, path string, content binary, size int")
    for made, want in ((inputs.main_tex(f), {1: "a.tex", 2: "2101.00001.tex"}), (inputs.main_html(f), {})):
        assert "Window" not in made._jdf.queryExecution().toString() and {r.doc_id: r.main for r in made.collect()} == want
