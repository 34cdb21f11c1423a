import io
import json
import os
import tarfile
import zipfile

from pyspark.sql import functions as F

from quirework.operators import authors as A
from quirework.operators import tex, traverse
from quirework.operators import pages as P
from quirework.functions import dom
from quirework.functions.dom import parse
from quirework.plans import batch, markup_queries
from quirework.plans import pipeline as PL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PAGE = """<html><head><title>My paper - arXiv</title></head><body><article class="ltx_document"><h1 class="ltx_title ltx_title_document">My <b>Paper</b></h1>
<div class="ltx_authors"><span class="ltx_creator ltx_role_author"><span class="ltx_personname">Jane Doe<br>MIT</span></span></div><div class="ltx_abstract"><h6>Abstract</h6><p>We do <em>it</em>.</p></div>
<section id="S1" class="ltx_section"><h2>1 Intro</h2><p>See Figure 2 and <a href="#bib.bib3">[3]</a> with <math alttext="x^2"></math>.<span class="ltx_note ltx_role_footnote"><sup class="ltx_note_mark">1</sup><span class="ltx_note_content">A note</span></span></p>
<figure class="ltx_figure" id="S1.F1"><img src="a.png" alt="Refer to caption"><figcaption>Figure 1: One</figcaption></figure><ul><li>one</li><li>two<ul><li>deep</li></ul></li></ul>
<figure class="ltx_figure" id="S1.F2"><img src="b.png"><figcaption>no number</figcaption></figure>
<section class="ltx_subsection" id="S1.SS1"><h3>Sub</h3><table class="ltx_equation"><tr><td><math alttext="E=mc^2"></math></td><td><span class="ltx_tag_equation">(1)</span></td></tr></table><table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td></tr></table><pre>code</pre><blockquote><p>quoted</p></blockquote></section></section>
<section class="ltx_section"><h2>Empty</h2></section><section class="ltx_bibliography"><h2>References</h2><ul><li id="bib.bib1">Doe, J. A title. 2020.</li></ul></section><section class="ltx_appendix"><h2>Extra</h2><p>x</p></section></article></body></html>"""
CONTENT = """## Abstract

We do *it*.

## 1 Intro

See Figure 2 and [3] with $x^2$.<sup>1</sup>

![](b.png)

> no number

> Footnote 1: A note

![](a.png)

> Figure 1: One

- one
- two
  - deep

### Sub

$$
E=mc^2 \\tag{1}
$$

| a | b\\|c |
| --- | --- |
| 1 |  |

```
code
```

> quoted
"""


def test_page_to_markdown(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<p>plain"), (3, None), (4, "")], "doc_id long, html string")
    t = PL.convert(df)
    md = {r.doc_id: r for r in PL.to_markdown(t).collect()}
    assert md[1].content == CONTENT
    assert md[1].content_references == '## References\n\n- <a id="ref-1"></a>[1] Doe, J. A title. 2020.\n'.replace('<a id="ref-1"></a>', "")
    assert md[1].content_appendix == "## Extra\n\nx\n"
    s = {r.doc_id: r for r in PL.summary(t).collect()}
    assert s[1].summary == "Title: My Paper\nAuthors: Jane Doe (MIT)\nSections: 4" and s[1].sections_tree == "1 Intro\n    Sub\nReferences\nExtra"
    assert set(s) == {1, 2, 3, 4}
    doc = {r.doc_id: json.loads(r.json) for r in PL.to_json(t, "full").collect()}
    assert doc[1]["meta"]["title"] == "My Paper" and [x["struct_id"] for x in doc[1]["sections"]] == ["sec_0", "sec_0_0", "sec_2", "sec_3"]
    assert PL.to_json(t, "nonsense").count() == 0


def test_section_options(spark):
    df = spark.createDataFrame([(1, PAGE)], "doc_id long, html string")
    only = PL.to_markdown(PL.convert(df, options=PL.Options("include", ("1 Intro", "Abstract")))).first().content
    assert "Extra" not in only and only.startswith("## Abstract") and "Sub" not in only
    without = PL.to_markdown(PL.convert(df, options=PL.Options("exclude", ("intro", "abstract")))).first()
    assert without.content is None and without.content_appendix == "## Extra\n\nx\n"


def test_reader_details():
    assert P.read_page(None)["blocks"] == [] and P.read_page("<article><section><h2>a")["sections"][0]["title"] == "a"
    assert P.listing_language("pip install x", "python") == "bash" and P.listing_language("x = 1", "python") == "python" and P.listing_language("a b c d", "python") == "text"
    assert P.link_kind("#bib.bib4") == ("citation", "ref-4") and P.link_kind("https://x.org") == ("external", "https://x.org") and P.link_kind("#S2.F3") == ("internal", "figure-3")
    page = P.read_page("<section><h2>x</h2><div class='ltx_listing ltx_lst_language_Java'><a href='data:text/plain;base64,aGk='>d</a></div></section>")
    assert (page["blocks"][0]["text"], page["blocks"][0]["language"]) == ("hi", "java")
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert parse(deep).text() == "x"


def test_traversal(spark):
    tree = traverse.nodes(P.parse_pages(spark.createDataFrame([(1, PAGE)], "doc_id long, html string")))
    n = {r.type: r.n for r in traverse.counts(tree).collect()}
    assert n["section"] == 5 and n["figure"] == 2 and n["author"] == 1 and n["document"] == 1 and n["link"] == 1
    assert traverse.texts(tree).first().texts[0] == "We do "


FILES = {
    "main.tex": r"""\documentclass{article}\title{A \emph{T}}\author{Jane Doe \and Max M}
\begin{document}\maketitle\begin{abstract}Short.\end{abstract}
\section{Intro}\label{sec:i} Text \textbf{bold} \cite{k2} and $x^2$.\footnote{note} % comment
\input{sec2}
\iffalse gone \else kept \fi
\begin{equation}E=mc^2\label{e}\end{equation}
\subsection*{Un} \begin{itemize}\item a \item b \begin{enumerate}\item c\end{enumerate}\end{itemize}
\begin{table}\caption{Cap}\begin{tabular}{ll}\toprule a & b \\ \midrule 1 & 2\\ \end{tabular}\end{table}
\begin{figure}\includegraphics[width=1cm]{f.png}\caption{Fig}\label{f}\end{figure}
\bibliography{x}\end{document}""",
    "sec2.tex": "Included.\n\n\\end{foo}",
    "main.bbl": r"\begin{thebibliography}{9}\bibitem{k1} One. \bibitem{k2} Two.\end{thebibliography}",
}


def test_tex_archive(spark):
    fd = spark.createDataFrame([(7, p, c, "main.tex") for p, c in FILES.items()], "doc_id long, path string, content string, main string")
    t = PL.from_parsed(tex.parse_archives(fd), PL.Options(number_sections=True)).transform(*PL.DEFAULT)
    md = PL.to_markdown(t).first()
    for part in ("## Abstract\n\nShort.", "## 1 Intro\n\nText **bold** [2] and $x^2$.<sup>1</sup> Included.\n\n[^1]\n\nnote", "kept", "$$\nE=mc^2 \\tag{1}\n$$", "### Un\n\n- a\n- b\n  1. c", "| a | b |\n| --- | --- |\n| 1 | 2 |\n\n> Cap", "![](f.png)\n\n> Fig"):
        assert part in md.content
    assert "gone" not in md.content and "foo" not in md.content and md.content_references == "## References\n\n- [1] One.\n- [2] Two.\n".replace("- [1]", '- [1]')
    d = t.docs.first()
    assert d.title == "A T" and [a.name for a in d.authors] == ["Jane Doe", "Max M"] and d.abstract == "Short."


def test_tex_helpers():
    assert tex.comment_orphans("a\\end{x}b") == "a%\\end{x}\nb"
    assert tex.drop_false_branches("a\\if0 b\\else c\\fi d\\ifx e\\fi") == "a c d\\ifx e\\fi"
    assert tex.bibitem_numbers("\\bibitem{a}\\bibitem[x]{b}\\bibitem{a}") == {"a": 1, "b": 2}
    assert tex.expand_includes("m.tex", {"m.tex": "a\\input{n}b\\input{n}c\\include{gone}%\\input{n}", "n.tex": "N\\input{m}"}) == "aNbc%\\input{n}"
    assert tex.read_tex(None, {})["blocks"] == [] and tex.read_ast("{")["blocks"] == []
    ast = {"meta": {"title": {"t": "MetaInlines", "c": [{"t": "Str", "c": "T"}]}}, "blocks": [{"t": "Header", "c": [1, ["a", [], []], [{"t": "Str", "c": "H"}]]}, {"t": "Para", "c": [{"t": "Str", "c": "x"}, {"t": "Math", "c": [{"t": "DisplayMath"}, "y"]}]}, {"t": "Odd", "c": []}]}
    got = tex.read_ast(json.dumps(ast))
    assert got["title"] == "T" and [b["kind"] for b in got["blocks"]] == ["paragraph", "equation", "raw"]


def test_tex_authors():
    assert A.tex_authors(r"\author{Jane Doe$^{1,2}$, Max Muster$^{12}$ \\ $^1$ MIT \\ $^2$ ETH Zurich}\begin{document}\maketitle") == [("Jane Doe", ["MIT", "ETH Zurich"]), ("Max Muster", ["MIT", "ETH Zurich"])]
    assert A.tex_authors(r"\icmlaffiliation{a}{MIT}\icmlauthor{Jane Doe}{a}\icmlauthor{X Y}{a}") == [("Jane Doe", ["MIT"]), ("X Y", ["MIT"])]
    assert A.tex_authors(r"\author{\IEEEauthorblockN{Jane Doe, X Y}\IEEEauthorblockA{Uni A\\ City\\ a@b.c}}") == [("Jane Doe", ["Uni A", "City"]), ("X Y", ["Uni A", "City"])]
    assert A.tex_authors(r"\author{Jane Doe}\author{X Y}\affiliation{Uni Z}") == [("Jane Doe", ["Uni Z"]), ("X Y", ["Uni Z"])]
    assert A.tex_authors(r"\author{Jane Doe\thanks{a {b}} \\ Uni A \and X Y \\ Uni B}") == [("Jane Doe", ["Uni A"]), ("X Y", ["Uni B"])]
    assert A.tex_authors(None) == [] and A.tex_authors("\\author{") == []
    names, hints = A.abstract_page_authors(parse('<div class="authors"><a>Jane Doe</a></div><meta name="citation_author_institution" content="MIT">'))
    assert (names, hints) == (["Jane Doe"], ["MIT"])


def test_batch(spark, tmp_path):
    page = '<article class="ltx_document"><h1 class="ltx_title ltx_title_document">P{0}</h1><section class="ltx_section"><h2>S</h2><p>text {0}</p></section></article>'
    (tmp_path / "a.html").write_text(page.format("local"))
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        for name, text in (FILES | {"f.png": "x"}).items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            t.addfile(info, io.BytesIO(text.encode()))
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("index.html", page.format("zipped"))
    (tmp_path / "d.zip").write_bytes(b"PKbroken")
    lines = ["# list", "", "2101.00001", "2101.00001", "2101.00002", "2101.00003", f"{tmp_path}/a.html", f"{tmp_path}/b.tar.gz", f"{tmp_path}/c.zip", f"{tmp_path}/d.zip", f"{tmp_path}/gone.html", "what is it"]
    (tmp_path / "lines.txt").write_text("\n".join(lines))

    def maker():
        def fetch(url):
            if url.endswith("00001"):
                return 200, "text/html", page.format("remote").encode()
            if url.endswith("00002"):
                return 200, "text/html", b"<title> No content available </title>"
            return 404, "", b""

        return fetch

    documents, outcomes = batch.run_batch(batch.I.batch_lines(spark, str(tmp_path / "lines.txt")), make_fetcher=maker, tries=1)
    got = [(r.line, r.status, r.error) for r in outcomes.orderBy("n").collect()]
    assert [x[0] for x in got] == lines and [x[1] for x in got] == ["skip", "skip", "ok", "ok", "error", "error", "ok", "ok", "ok", "error", "error", "error"]
    assert [x[2] for x in got if x[2]] == ["NetworkError: no page for this source", "NetworkError: not found", "IngestionError: an archive without a TeX file or a page", "StorageError: FileNotFoundError", "UserInputError: neither an arXiv id nor a page or archive"]
    counts = batch.report(outcomes)
    assert {r.status: r.n for r in counts.collect()} == {"ok": 5, "skip": 2, "error": 5} and batch.exit_code(counts) == 1
    assert batch.until_first_error(outcomes).count() == 5
    assert {r.c for r in outcomes.select(batch.error_class(F.col("error")).alias("c")).collect()} == {None, "NetworkError", "IngestionError", "StorageError", "UserInputError"}
    text = {r.title: r.content for r in documents.collect()}
    assert set(text) == {"Premote", "Plocal", "Pzipped", "A T"} and text["Plocal"] == "## S\n\ntext local\n" and "![](f.png)" in text["A T"] and "## 1 Intro" in text["A T"]
    without = batch.run_batch(batch.I.batch_lines(spark, str(tmp_path / "lines.txt")).filter("kind = 'arxiv'"))[1]
    assert {r.error for r in without.collect()} == {"NetworkError: no fetcher is installed"}


def test_stubs(spark):
    stub = batch.with_stubs(spark.createDataFrame([("a", None, "not found"), ("b", "<p>", None)], "id string, html string, error string"))
    assert [r.is_stub for r in stub.orderBy("id").collect()] == [True, False]


def test_cuts_at_display_formulas():
    show = lambda ts: [(t["op"], t["style"] or t["text"]) for t in ts]
    tok, math = P._tok, P._tok("math", "z", display=True)
    tokens = [tok("open", style="italic"), tok("text", "a "), math, tok("open", style="bold"), tok("text", " "), tok("close", style="bold"), tok("text", " b "), tok("close", style="italic"), math, tok("text", " ")]
    got = [(latex, show(run)) for latex, run in P.cut_at_display(tokens)]
    one = lambda t: [("open", "italic"), ("text", t), ("close", "italic")]
    assert got == [(None, one("a")), ("z", []), (None, one("b")), ("z", [])]
    page = P.read_page('<section><h2>x</h2><p><em>a <math display="block" alttext="z"></math> b</em></p></section>')
    assert [(b["kind"], show(b["inlines"])) for b in page["blocks"]] == [("paragraph", one("a")), ("equation", []), ("paragraph", one("b"))]
    text = tex.read_tex("m", {"m": "\\section{s} \\emph{a \\[z\\] b}"})
    assert [(b["kind"], show(b["inlines"])) for b in text["blocks"]] == [("paragraph", one("a")), ("equation", []), ("paragraph", one("b"))]


def test_front_matter_and_drawn_figures(spark):
    html = """<article class="ltx_document"><div class="ltx_abstract"><p>abs</p></div><figure class="ltx_figure" id="f0"><svg width="5"><path d="M0"/></svg><figcaption>Figure 1: teaser</figcaption></figure><p>not this</p>
    <section class="ltx_section"><h2>One</h2><figure class="ltx_figure"><svg></svg></figure><figure class="ltx_figure"></figure></section></article>"""
    t = PL.convert(spark.createDataFrame([(1, html)], "doc_id int, html string"))
    got = {(r.region, r.kind, r.number, r.anchor) for r in t.blocks.collect()}
    assert {x for x in got if x[1] == "figure"} == {("front_matter", "figure", 1, "figure-1"), ("section", "figure", 1, "figure-1-2")}
    assert {(r.path, r.kind, r.content) for r in PL.to_assets(t).collect()} == {("images/figure-1.svg", "svg", '<svg width="5"><path d="M0"></path></svg>'), ("images/figure-2.svg", "svg", "<svg></svg>")}
    assert "teaser" not in PL.to_markdown(t).first().content and "images/figure-2.svg" in PL.to_markdown(t).first().content


def test_missing_braces():
    assert tex.close_braces("\\emph{a % {\n\\{ \\end{document}") == "\\emph{a % {\n\\{ }\\end{document}"
    assert tex.close_braces("{" * 26 + "\\end{document}") == "{" * 26 + "\\end{document}"
    blocks = tex.read_tex("m", {"m": "\\begin{document}\\section{s}a \\emph{b\n\n\\end{document}"})["blocks"]
    assert [b["kind"] for b in blocks] == ["paragraph"]


def test_plain_trees_are_the_standard_parsers():
    def shown(e):
        return e if isinstance(e, str) else (e.tag, tuple(e.attrs.items()), tuple(shown(k) for k in e.kids))

    def standard(t):
        b = dom._Builder()
        b.feed(t)
        b.close()
        return shown(b.root)

    plain = ["<p>a &amp; b<br>c</p>", '<DIV Class="A&lt;b" a="1" a="2"><img src="" /></div></p>tail', "<title>x</title> a > b", "<p></div>open", '<a href="x>y">&am</a>', "x &copy"]
    odd = ["<script>a<b</script>", "a < b", "<p>x<!-- c -->y</p>", "<i a='q'>z</i>", "<p>x<", "<x-y>n</x >", "<b\f>", "<t a=1>", "<p>&amp"]
    for t in plain:
        assert shown(dom._plain_tree(t)) == standard(t)
    for t in [*plain, *odd]:
        assert shown(dom.parse(t)) == standard(t)


def test_short_rows_become_documents_in_several_tasks(spark, tmp_path):
    spark.range(5000).selectExpr("id p_partkey", "'n' p_name", "1 p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    made = markup_queries.parts(spark, str(tmp_path), html="<p>‹key›</p>")
    assert made.rdd.getNumPartitions() == 3 and made.filter("html = concat('<p>', doc_id, '</p>')").count() == 5000


def test_archives_are_read_in_batches(spark):
    rows = [(k, p, c, "a.tex") for k in range(3) for p, c in (("a.tex", f"\\section{{S{k}}} \\input{{b}}"), ("b.tex", "text"), ("c.png", None))]
    for kind in ("string", "binary"):
        parsed = tex.parse_archives(spark.createDataFrame(rows, "doc_id int, path string, content string, main string").withColumn("content", F.col("content").cast(kind)))
        assert "FlatMapGroups" not in parsed._jdf.queryExecution().toString()
        assert {(r.doc_id, r.sections[0].title, r.blocks[0].text) for r in parsed.collect()} == {(k, f"S{k}", "text") for k in range(3)}


def test_tree_documents_parses_once(spark):
    if os.path.isdir(DATA):
        assert "MapInArrow" not in markup_queries.tree_documents(spark, DATA)._jdf.queryExecution().toString()
