"""Queries of the markup readers and writers: documents made from a template and a table's columns, read and written by the operators.

A template holds columns in ‹›. The SQL fills the expected text, written out below, with the same columns, so it shares nothing
with the operators. Every query reads its whole table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import spread, table
from ..operators import authors as A
from ..operators import pages as P
from ..operators import tex as TX
from . import pipeline as PL

#: Columns that templates name.
FIELDS = {"key": "p_partkey", "name": "p_name", "size": "p_size"}
_HOLE = re.compile("‹(\\w+)›")


def filled(template: str) -> Column:
    parts = _HOLE.split(template)
    return F.concat(*[F.col(FIELDS[x]).cast("string") if k % 2 else F.lit(x) for k, x in enumerate(parts) if x])


def filled_sql(template: str) -> str:
    parts = _HOLE.split(template)
    return "concat(" + ", ".join(FIELDS[x] if k % 2 else "'" + x.replace("'", "''") + "'" for k, x in enumerate(parts) if x) + ")"


def parts(spark: SparkSession, d: str, **templates: str) -> DataFrame:
    """doc_id and a filled column for each template. A row of a few bytes becomes a document, so the rows are spread first."""
    return spread(table(spark, d, "part").select(*FIELDS.values())).select(F.col("p_partkey").alias("doc_id"), *[filled(t).alias(c) for c, t in templates.items()])


def expected(**columns: str) -> str:
    """The SQL of a query whose columns are filled templates, null where there is none."""
    return "SELECT p_partkey AS doc_id, " + ", ".join(f"{filled_sql(t) if t else 'NULL'} AS {c}" for c, t in columns.items()) + " FROM part"


def page(body: str, title: str = "Title ‹key›", before: str = "") -> str:
    return f'<html><body><article class="ltx_document"><h1 class="ltx_title ltx_title_document">{title}</h1>{before}{body}</article></body></html>'


def section(inner: str, head: str = "Head ‹key›", kind: str = "ltx_section", ident: str = "S1", tag: str = "h2") -> str:
    return f'<section class="{kind}" id="{ident}"><{tag}>{head}</{tag}>{inner}</section>'


def written(spark: SparkSession, d: str, html: str, options: PL.Options = PL.Options()) -> DataFrame:
    return PL.to_markdown(PL.convert(parts(spark, d, html=html), options=options))


INLINES = page(section(
    '<p>Plain ‹name› with <em>soft ‹name›</em>, <strong>hard</strong>, <code>c ‹size›</code>, <a href="https://x.org/a b(1)">out</a>, <a href="#S3">in</a>, H<sub>2</sub>O<sup>‹size›</sup>, '
    '<math alttext="x^{‹size›}"></math>and <span class="ltx_text ltx_font_bold">fat</span> <u>low</u> <s>gone</s><br>[next] <a href="#bib.bib‹size›">Someone 2020</a>, <cite>Q</cite>, <em> </em><unknown>raw</unknown>.</p>'
    '<p>before <em>a <math display="block" alttext="y_{‹key›}"></math> b</em> after<span class="ltx_note ltx_role_footnote"><sup class="ltx_note_mark">1</sup><span class="ltx_note_content">noted ‹name›</span></span></p>'
    '<blockquote><p>quoted ‹name›</p></blockquote><hr><pre>code  ‹name›\n  more</pre>loose text',
))
EQUATIONS = page(section(
    '<table class="ltx_equation" id="S1.E1"><tr><td><math alttext="E=‹size›c^2"></math></td><td class="ltx_eqn_eqno"><span class="ltx_tag ltx_tag_equation">(7)</span></td></tr></table>'
    '<div class="ltx_equation"><math alttext="$a$"></math><math alttext="b \\tag{1}"></math></div><p>where <math alttext="\\alpha\\color[rgb]{1,0,0}x\\mbox{if $y$ ‹name›}"></math></p>'
))
FIGURES = page(section(
    '<p>See Figure 3.</p><figure class="ltx_figure" id="S1.F1"><img src="a b.png" alt="Refer to caption"><figcaption>Figure 1: One ‹name›</figcaption></figure>'
    '<figure class="ltx_figure" id="S1.F2"><img src="c.png" alt="[seen]"><img src="d.png" alt="e"><figcaption>two panels</figcaption></figure>'
    '<figure class="ltx_figure" id="S1.F3"><img src="f.png"><img src="g.png"><img src="h.png"><figcaption>Figure 3: Three</figcaption></figure>'
    '<figure class="ltx_float ltx_float_algorithm" id="alg1"><figcaption>Algorithm 2: Do ‹name›</figcaption></figure><figure class="ltx_figure"><figcaption>nothing here</figcaption></figure>'
    '<figure class="ltx_figure"><svg width="‹size›"><path d="M0 0"></path></svg></figure>'
))
TABLES = page(section(
    '<figure class="ltx_table" id="S1.T1"><table><thead><tr><th>a</th><th>b|‹size›</th></tr><tr><th>lost</th></tr></thead><tbody><tr><td>1</td><td><em>‹name›</em></td><td>3</td></tr></tbody></table><figcaption>Table 1: lost too</figcaption></figure>'
    '<table><caption>Table 4: kept ‹name›</caption><tr><td>x</td></tr><tr><td>y<br>z</td><td>w</td></tr></table>'
))
LISTS = page(section(
    '<ul><li>one ‹name›</li><li>two<ol><li>deep</li><li>deeper</li></ol></li></ul><ol><li><p>first</p><p>second paragraph</p></li></ol>'
    '<ul class="ltx_itemize"><li class="ltx_item"><span class="ltx_tag ltx_tag_item">•</span><div class="ltx_para"><p class="ltx_p">tagged</p></div></li></ul>'
))
LISTINGS = page(section("".join(
    f'<div class="ltx_listing ltx_lst_language_{lang}"><div class="ltx_listing_data"><a href="data:text/plain;base64,{code}">dl</a></div></div>'
    for lang, code in (("Python", "eCA9IDE="), ("Python", "bnBtIGluc3RhbGwgeA=="), ("Python", "Z2NjIGEuYw=="), ("Python", "bHMgLWwgfA=="), ("Java", "Y2xhc3MgQSB7fQ=="))
) + '<div class="ltx_listing"><div class="ltx_listingline"><span class="ltx_tag ltx_tag_listingline">1</span>line ‹name›</div><div class="ltx_listingline">two  </div></div>'))
WHOLE = page(
    section("<p>main ‹name›</p>" + section("<p>deeper</p>", "Sub ‹size›", "ltx_subsection", "S1.SS1", "h3") + section("", "Empty", "ltx_subsection", "S1.SS2", "h3"), "1 Intro ‹key›")
    + '<section class="ltx_bibliography" id="bib"><h2>References</h2><ul><li id="bib.bib1">Doe, ‹name›. 2020.</li><li id="bib.bib2">Roe.</li></ul></section>' + section("<p>extra ‹key›</p>", "Extra", "ltx_appendix", "A1"),
    before='<div class="ltx_abstract"><h6>Abstract</h6><p>We study ‹name›.</p></div><figure class="ltx_figure" id="f0"><img src="t.png"><figcaption>teaser</figcaption></figure><nav><h2>Contents</h2></nav>',
)

TEX = (
    "\\documentclass{article}\\title{A \\emph{‹name›}}\\author{Ada Low \\and Max Muster}\\begin{document}\\maketitle\\begin{abstract}Short ‹size›.\\end{abstract}\n"
    "\\section{Intro ‹key›}\\label{sec:i} Text \\textbf{‹name›} \\cite{k2,k1} and $x^{‹size›}$.\\footnote{note ‹key›} % comment\n\n\\input{sec2}\n\n\\iffalse gone \\else kept \\fi \\vskip 1pt see \\ref{sec:i}, \\href{https://x.org}{out}, \\url{https://y.org}.\n"
    "\\begin{equation}E=‹size›c^2\\label{e}\\end{equation}\nemph \\emph{a \\[z\\] b}\n\\subsection*{Un} \\begin{itemize}\\item a \\item b \\begin{enumerate}\\item c\\end{enumerate}\\end{itemize}\n"
    "\\subsection{Two}\\begin{table}\\caption{Cap}\\begin{tabular}{ll}\\toprule a & b \\\\ \\midrule 1 & ‹name›\\\\ \\end{tabular}\\end{table}\n\\begin{figure}\\includegraphics[width=1cm]{f}\\caption{Fig ‹key›}\\label{f}\\end{figure}\n"
    "\\begin{verbatim}\ncode ‹size›\n\\end{verbatim}\\begin{quote}said\\end{quote}\\end{itemize}\\bibliography{x}\\end{document}"
)
SEC2 = "Included ‹name›.\\lstinputlisting{run.py}"
BBL = "\\begin{thebibliography}{9}\\bibitem{k1} One. \\bibitem[x]{k2} Two ‹key›.\\end{thebibliography}"


def tex_parsed(spark: SparkSession, d: str) -> DataFrame:
    """An archive of six files for each row, read from its main file."""
    files = {"main.tex": TEX, "sec2.tex": SEC2, "main.bbl": BBL, "run.py": "print(‹size›)\n", "img/f.png": "", "f.bak": ""}
    made = parts(spark, d, **{f"f{k}": t for k, t in enumerate(files.values()) if t})
    rows = F.array(*[F.struct(F.lit(n).alias("path"), (F.col(f"f{k}") if t else F.lit("")).alias("content"), F.lit("main.tex").alias("main")) for k, (n, t) in enumerate(files.items())])
    return TX.parse_archives(made.select("doc_id", F.inline(rows)))


def tex_documents(spark: SparkSession, d: str) -> DataFrame:
    return PL.to_markdown(PL.from_parsed(tex_parsed(spark, d), PL.Options(number_sections=True)).transform(*PL.DEFAULT)).select("doc_id", "content", "content_references")


TREE = (
    '{"pandoc-api-version":[1,23],"meta":{"title":{"t":"MetaInlines","c":[{"t":"Str","c":"‹name›"}]},"author":{"t":"MetaList","c":[{"t":"MetaInlines","c":[{"t":"Str","c":"Ada"}]}]},"abstract":{"t":"MetaBlocks","c":[{"t":"Para","c":[{"t":"Str","c":"Short"}]}]}},'
    '"blocks":[{"t":"Para","c":[{"t":"Str","c":"lost"}]},{"t":"Header","c":[1,["a",[],[]],[{"t":"Str","c":"Head"},{"t":"Space"},{"t":"Str","c":"‹key›"}]]},'
    '{"t":"Para","c":[{"t":"Emph","c":[{"t":"Str","c":"‹name›"}]},{"t":"Space"},{"t":"Strong","c":[{"t":"Str","c":"x"}]},{"t":"Space"},{"t":"Math","c":[{"t":"InlineMath"},"y_{‹size›}"]},{"t":"Math","c":[{"t":"DisplayMath"},"z\\\\label{q}"]},{"t":"Quoted","c":[{"t":"DoubleQuote"},[{"t":"Str","c":"q"}]]},{"t":"Note","c":[{"t":"Para","c":[{"t":"Str","c":"noted"}]}]},{"t":"Cite","c":[[{"citationId":"k9"}],[]]},{"t":"RawInline","c":["tex","\\\\cite{a}"]},{"t":"Link","c":[["",[],[]],[{"t":"Str","c":"l"}],["#a",""]]},{"t":"Code","c":[["",[],[]],"c"]},{"t":"Superscript","c":[{"t":"Str","c":"2"}]},{"t":"Strikeout","c":[{"t":"Str","c":"s"}]},{"t":"LineBreak"},{"t":"Str","c":"end"}]},'
    '{"t":"BulletList","c":[[{"t":"Plain","c":[{"t":"Str","c":"one"}]}],[{"t":"Plain","c":[{"t":"Str","c":"two"}]}]]},{"t":"CodeBlock","c":[["",["python"],[]],"x = ‹size›"]},{"t":"BlockQuote","c":[{"t":"Para","c":[{"t":"Str","c":"quoted"}]}]},{"t":"HorizontalRule"},{"t":"Div","c":[["",[],[]],[{"t":"Para","c":[{"t":"Str","c":"inside"}]}]]},'
    '{"t":"Figure","c":[["fig",[],[]],[null,[{"t":"Plain","c":[{"t":"Str","c":"Cap"}]}]],[{"t":"Plain","c":[{"t":"Image","c":[["",[],[]],[],["‹key›.png",""]]}]}]]},'
    '{"t":"Table","c":[["",[],[]],[null,[]],[],[["",[],[]],[[["",[],[]],[[["",[],[]],{"t":"AlignDefault"},1,1,[{"t":"Plain","c":[{"t":"Str","c":"h"}]}]]]]]],[[["",[],[]],0,[],[[["",[],[]],[[["",[],[]],{"t":"AlignDefault"},1,1,[{"t":"Plain","c":[{"t":"Str","c":"‹name›"}]}]]]]]]],[["",[],[]],[]]]},'
    '{"t":"LineBlock","c":[[{"t":"Str","c":"v1"}],[{"t":"Str","c":"v2"}]]},{"t":"RawBlock","c":["tex","\\\\raw{‹size›}"]},{"t":"Null"},{"t":"Strange","c":[]}]}'
)


def tree_documents(spark: SparkSession, d: str) -> DataFrame:
    """Parser trees, one with formulas, notes, lists, a table and what isn't known for each row."""
    t = PL.from_parsed(TX.parse_trees(parts(spark, d, ast=TREE))).transform(*PL.DEFAULT)
    return t.docs.select("doc_id", "title", F.array_join("authors.name", ";").alias("authors"), "abstract").join(PL.to_markdown(t).select("doc_id", "content"), "doc_id")


def inline_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every kind of inline, emphasis cut by a display formula, a footnote, quote, rule, code and loose text."""
    return written(spark, d, INLINES).select("doc_id", "content")


def page_equations(spark: SparkSession, d: str) -> DataFrame:
    return written(spark, d, EQUATIONS).select("doc_id", "content")


def page_figures(spark: SparkSession, d: str) -> DataFrame:
    """Figures of one, two and three panels, an algorithm, an empty and a drawn figure; one moves behind the paragraph that cites it. Anchors are printed."""
    return written(spark, d, FIGURES, PL.Options(anchors=True)).select("doc_id", "content")


def page_tables(spark: SparkSession, d: str) -> DataFrame:
    return written(spark, d, TABLES).select("doc_id", "content")


def page_lists(spark: SparkSession, d: str) -> DataFrame:
    return written(spark, d, LISTS).select("doc_id", "content")


def listing_languages(spark: SparkSession, d: str) -> DataFrame:
    return written(spark, d, LISTINGS).select("doc_id", "content")


def whole_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page in its three parts, its summary's tree and its hash."""
    t = PL.stored(PL.convert(parts(spark, d, html=WHOLE)))
    return PL.to_markdown(t).join(PL.summary(t), "doc_id").join(PL.content_fingerprint(t), "doc_id")


def json_documents(spark: SparkSession, d: str) -> DataFrame:
    """The same pages as JSON: metadata, sections and blocks."""
    t = PL.convert(parts(spark, d, html=WHOLE))
    return PL.to_json(t, "full")


def drawn_figures(spark: SparkSession, d: str) -> DataFrame:
    """Images of the figures' page as assets, with the markup of the drawn one."""
    return PL.to_assets(PL.convert(parts(spark, d, html=FIGURES))).select("doc_id", "path", "kind", "stem", "content")


def math_latex(spark: SparkSession, d: str) -> DataFrame:
    """Formulas with what a page's TeX has beside the formula, one a section."""
    forms = [
        "\\alpha\\color{red}x_{‹size›}", "\\alpha%\nx", "\\definecolor[named]{p}{rgb}{1,0,0}y\\pgfsys@color@rgb@stroke{1}{0}\\pgfsys@color@rgb@fill{1}{0}z", "\\displaystyle{ \\bf Z}\t\n‹key›", "\\begin{array}[] {cl}a\\end{array}",
        "a\\mbox{${}\\perp\\mkern-11.0mu\\perp{}$}b", "\\mbox{at $\\alpha$ ‹name›}", "x\\nolinebreak[4]y", "50\\% of \\text{ if }",
    ]
    html = page("".join(section(f'<math alttext="{x}"></math>') for x in forms))
    blocks = P.blocks_of(P.parse_pages(parts(spark, d, html=html)))
    return blocks.filter("kind = 'paragraph'").select("doc_id", "sec_pos", F.get("inlines", F.lit(0))["text"].alias("latex"))


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    """What stands between the abstract and the first section, with the abstract and the date."""
    html = page(section("<p>x</p>"), before='<meta name="citation_date" content="2020/‹size›/1"><div class="ltx_abstract"><h6>Abstract.</h6><p>We study ‹name›.</p></div><div class="ltx_para"><p class="ltx_p">kept ‹key›</p></div><p>left out</p>')
    parsed = P.parse_pages(parts(spark, d, html=html))
    blocks = P.blocks_of(parsed).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", F.concat_ws(":", "region", "text").alias("t"))))["t"], "|").alias("blocks"))
    return parsed.select("doc_id", "title", "abstract", "submission_date").join(blocks, "doc_id")


def page_titles(spark: SparkSession, d: str) -> DataFrame:
    """Where a page's title is taken from, by what the page has."""
    kinds = {
        0: page("", "[1] Own ‹name› Contents"), 1: "<h1 class='paper-title'>Paper ‹name›</h1>", 2: "<head><meta property='og:title' content='Meta ‹name›'></head>",
        3: "<title>Tab ‹name› | arXiv.org</title>", 4: "<title>arXiv</title>",
    }
    made = parts(spark, d, **{f"k{k}": t for k, t in kinds.items()})
    html = F.coalesce(*[F.when(F.pmod("doc_id", F.lit(len(kinds))) == k, F.col(f"k{k}")) for k in kinds])
    return P.parse_pages(made.select("doc_id", html.alias("html"))).select("doc_id", "title")


def heading_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Headings with their own id, their parent's, or none; headings of the contents and the abstract aren't sections."""
    html = page('<nav><h2>Contents</h2></nav><div class="ltx_abstract"><h2>Abstract</h2></div><section id="P‹key›"><h2 id="h‹size›">a</h2></section><section id="S‹key›"><h3>b</h3></section><section><h7>no</h7><h6>c</h6></section>')
    return P.sections_of(P.parse_pages(parts(spark, d, html=html))).select("doc_id", "pos", "level", "title", "anchor")


#: A name that is told as one: its number in letters.
_LETTERS = "translate({0}, '0123456789', 'abcdefghij')"


def _named(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("X"), F.translate(F.col("p_partkey").cast("string"), "0123456789", "abcdefghij")).alias("x"))


def page_authors(spark: SparkSession, d: str) -> DataFrame:
    """Authors with affiliations in five styles: notes, lines, a table's cells, bold and italic spans in sequence, names alone."""
    creator = '<span class="ltx_creator ltx_role_author">{0}</span>'
    styles = {
        0: creator.format('<span class="ltx_personname">Ada ‹x›<sup>1</sup></span><span class="ltx_role_affiliation">University of ‹x›</span><span class="ltx_role_affiliation">university of ‹x›</span>'),
        1: creator.format('<span class="ltx_personname">Ada ‹x›<br>University of ‹x›<br>ada@x.org<br>&amp; Bob ‹x›<br>Paris, France<br>Equal contribution</span>'),
        2: creator.format('<span class="ltx_personname"><span class="ltx_tabular"><span class="ltx_td"><span class="ltx_font_bold">Ada ‹x›</span><span class="ltx_font_italic">Lab ‹x›</span></span><span class="ltx_td"><span class="ltx_font_bold">Bob ‹x›</span></span></span></span>'),
        3: '<p><span class="ltx_font_bold">Ada ‹x›</span><span>University of ‹x›</span><span>This is a sentence. It is skipped.</span><span>Bob ‹x›</span></p>',
        4: creator.format('<span class="ltx_personname">Ada ‹x›</span>') + creator.format('<span class="ltx_personname">Bob ‹x›</span>'),
    }
    put = lambda t: F.concat(*[F.col("x") if k % 2 else F.lit(p) for k, p in enumerate(_HOLE.split(t)) if p])
    html = F.coalesce(*[F.when(F.pmod("doc_id", F.lit(5)) == k, put(f'<article><div class="ltx_authors">{t}</div></article>')) for k, t in styles.items()])
    parsed = P.parse_pages(_named(spark, d).select("doc_id", html.alias("html")))
    return parsed.select("doc_id", F.posexplode("authors").alias("ord", "a")).select("doc_id", "ord", "a.name", F.array_join("a.affiliations", "|").alias("affiliations"))


def tex_authors(spark: SparkSession, d: str) -> DataFrame:
    """Authors with affiliations in five TeX styles, the first that gives any counting."""
    styles = {
        0: r"\icmlaffiliation{a}{Uni ‹x›}\icmlaffiliation{b}{Lab}\icmlauthor{Ada ‹x›}{a,b}\icmlauthor{Bob}{b}", 1: r"\author{\IEEEauthorblockN{Ada ‹x›, Bob}\IEEEauthorblockA{Uni ‹x›\\ City\\ a@b.c}}",
        2: r"\author{Ada ‹x›$^{1,2}$, Bob$^{12}$ \\ $^1$ Uni ‹x› \\ $^2$ Lab}\begin{document}\maketitle", 3: r"\author{Ada ‹x›}\author{Bob} % \author{Eve}" + "\n" + r"\affiliation{Uni ‹x›}",
        4: r"\author{Ada ‹x›\thanks{a {b}} \\ Uni ‹x› \and Bob \\ Lab}",
    }
    put = lambda t: F.concat(*[F.col("x") if k % 2 else F.lit(p) for k, p in enumerate(_HOLE.split(t)) if p])
    text = F.coalesce(*[F.when(F.pmod("doc_id", F.lit(5)) == k, put(t)) for k, t in styles.items()])
    return A.tex_author_rows(_named(spark, d).select("doc_id", text.alias("text"))).select("doc_id", "ord", "name", F.array_join("affiliations", "|").alias("affiliations"))


QUERIES = [
    inline_runs, page_equations, page_figures, page_tables, page_lists, listing_languages, whole_pages, json_documents, drawn_figures, math_latex, front_matter, page_titles, heading_anchors, page_authors, tex_authors, tex_documents, tree_documents,
]

_X = "'X' || " + _LETTERS.format("p_partkey::VARCHAR")


def sql() -> dict[str, str]:
    return {
        "inline_runs": expected(content=(
            "## Head ‹key›\n\nPlain ‹name› with *soft ‹name›*, **hard**, `c ‹size›`, [out](https://x.org/a%20b%281%29), [in](#section-3), H<sub>2</sub>O<sup>‹size›</sup>, $x^{‹size›}$ and **fat** <u>low</u> ~~gone~~\n\\[next\\] [‹size›], Q,  raw.\n\n"
            "before *a*\n\n$$\ny_{‹key›} \\tag{1}\n$$\n\n*b* after<sup>1</sup>\n\n> Footnote 1: noted ‹name›\n\n> quoted ‹name›\n\n---\n\n```\ncode  ‹name›\n  more\n```\n\nloose text\n")),
        "page_equations": expected(content="## Head ‹key›\n\n$$\nE=‹size›c^2 \\tag{7}\n$$\n\n$$\na b \\tag{2}\n$$\n\nwhere $\\alpha x\\text{if }y\\text{ ‹name›}$\n"),
        "page_figures": expected(content=(
            '<a id="sec_0"></a>\n\n## Head ‹key›\n\nSee Figure 3.\n\n<a id="figure-3"></a>\n\n<div align="center">\n<img src="f.png" alt="" width="30%">\n<img src="g.png" alt="" width="30%">\n<img src="h.png" alt="" width="30%">\n</div>\n\n> Figure 3: Three\n\n'
            '<a id="figure-1"></a>\n\n![](a%20b.png)\n\n> Figure 1: One ‹name›\n\n<a id="figure-2"></a>\n\n<div align="center">\n<img src="c.png" alt="seen" width="45%">\n<img src="d.png" alt="e" width="45%">\n</div>\n\n> two panels\n\n'
            '<a id="algorithm-2"></a>\n\n**Algorithm 2: Do ‹name›**\n\n<a id="figure-4"></a>\n\n![](images/figure-1.svg)\n')),
        "page_tables": expected(content="## Head ‹key›\n\n| a | b\\|‹size› |  |\n| --- | --- | --- |\n| 1 | *‹name›* | 3 |\n\n| x |  |\n| --- | --- |\n| y<br>z | w |\n\n> Table 4: kept ‹name›\n"),
        "page_lists": expected(content="## Head ‹key›\n\n- one ‹name›\n- two\n  1. deep\n  2. deeper\n\n1. first second paragraph\n\n- tagged\n"),
        "listing_languages": expected(content="## Head ‹key›\n\n```python\nx = 1\n```\n\n```bash\nnpm install x\n```\n\n```bash\ngcc a.c\n```\n\n```text\nls -l |\n```\n\n```java\nclass A {}\n```\n\n```text\nline ‹name›\ntwo\n```\n"),
        "whole_pages": f"""
            WITH p AS (SELECT p_partkey AS doc_id, p_name AS n, p_size AS z FROM part)
            SELECT doc_id, concat('## Abstract', chr(10), chr(10), 'We study ', n, '.', chr(10), chr(10), '## 1 Intro ', doc_id, chr(10), chr(10), 'main ', n, chr(10), chr(10), '### Sub ', z, chr(10), chr(10), 'deeper', chr(10)) AS content,
              concat('## References', chr(10), chr(10), '- [1] Doe, ', n, '. 2020.', chr(10), '- [2] Roe.', chr(10)) AS content_references, concat('## Extra', chr(10), chr(10), 'extra ', doc_id, chr(10)) AS content_appendix,
              concat('Title: Title ', doc_id, chr(10), 'Sections: 4') AS summary, concat('1 Intro ', doc_id, chr(10), '    Sub ', z, chr(10), 'References', chr(10), 'Extra') AS sections_tree,
              sha256(concat('We study ', n, '.', chr(10), 'main ', n, chr(10), 'deeper', chr(10), '- Doe, ', n, '. 2020.', chr(10), '- Roe.', chr(10), 'extra ', doc_id, chr(10))) AS sha256 FROM p""",
        "json_documents": expected(json=(
            '{"meta":{"schema_version":"2.0","title":"Title ‹key›","authors":[],"submission_date":null,"abstract":"We study ‹name›."},'
            '"sections":[{"struct_id":"sec_0","title":"1 Intro ‹key›","level":2,"anchor":"sec_0"},{"struct_id":"sec_0_0","title":"Sub ‹size›","level":3,"anchor":"sec_0_0"},{"struct_id":"sec_1","title":"References","level":2,"anchor":"sec_1"},{"struct_id":"sec_2","title":"Extra","level":2,"anchor":"sec_2"}],'
            '"blocks":[{"id":"abstract:b1:paragraph","type":"paragraph","section_id":null,"order_index":1,"text_plain":"We study ‹name›.","text_md":"We study ‹name›."},'
            '{"id":"front_matter:b2:figure","type":"figure","section_id":null,"order_index":2,"text_plain":"teaser","text_md":"![](t.png)\\n\\n> teaser"},'
            '{"id":"sec_0:b1:paragraph","type":"paragraph","section_id":"sec_0","order_index":1,"text_plain":"main ‹name›","text_md":"main ‹name›"},{"id":"sec_0_0:b1:paragraph","type":"paragraph","section_id":"sec_0_0","order_index":1,"text_plain":"deeper","text_md":"deeper"},'
            '{"id":"sec_1:b1:paragraph","type":"paragraph","section_id":"sec_1","order_index":1,"text_plain":"Doe, ‹name›. 2020.","text_md":"- Doe, ‹name›. 2020."},{"id":"sec_1:b2:paragraph","type":"paragraph","section_id":"sec_1","order_index":2,"text_plain":"Roe.","text_md":"- Roe."},'
            '{"id":"sec_2:b1:paragraph","type":"paragraph","section_id":"sec_2","order_index":1,"text_plain":"extra ‹key›","text_md":"extra ‹key›"}]}')),
        "drawn_figures": " UNION ALL ".join(
            f"SELECT p_partkey AS doc_id, '{p}' AS path, '{k}' AS kind, '{s}' AS stem, {filled_sql(c) if c else 'NULL'} AS content FROM part"
            for p, k, s, c in [(f"{x}.png", "image", x, "") for x in ("a b", "c", "d", "f", "g", "h")] + [("images/figure-1.svg", "svg", "figure-1", '<svg width="‹size›"><path d="M0 0"></path></svg>')]
        ),
        "math_latex": " UNION ALL ".join(
            f"SELECT p_partkey AS doc_id, {k} AS sec_pos, {filled_sql(x)} AS latex FROM part" for k, x in enumerate([
                "\\alpha x_{‹size›}", "\\alpha x", "y z", "{\\bf Z} ‹key›", "\\begin{array}{cl}a\\end{array}", "a\\perp \\!\\!\\! \\perp b", "\\text{at }\\alpha\\text{ ‹name›}", "xy", "50\\% of \\text{ if }",
            ])
        ),
        "front_matter": expected(title="Title ‹key›", abstract="We study ‹name›.", submission_date="2020/‹size›/1", blocks="abstract:We study ‹name›.|front_matter:kept ‹key›|section:x"),
        "page_titles": "SELECT p_partkey AS doc_id, CASE p_partkey % 5 WHEN 0 THEN 'Own ' || p_name WHEN 1 THEN 'Paper ' || p_name WHEN 2 THEN 'Meta ' || p_name WHEN 3 THEN 'Tab ' || p_name END AS title FROM part",
        "heading_anchors": """
            SELECT p_partkey AS doc_id, 0 AS pos, 2 AS level, 'a' AS title, 'h' || p_size AS anchor FROM part UNION ALL SELECT p_partkey, 1, 3, 'b', 'S' || p_partkey FROM part
            UNION ALL SELECT p_partkey, 2, 6, 'c', NULL FROM part""",
        "page_authors": f"""
            WITH n AS (SELECT p_partkey AS doc_id, p_partkey % 5 AS s, {_X} AS x FROM part)
            SELECT doc_id, 0 AS ord, 'Ada ' || x AS name, CASE s WHEN 2 THEN 'Lab ' || x WHEN 4 THEN '' ELSE 'University of ' || x END AS affiliations FROM n
            UNION ALL SELECT doc_id, 1, 'Bob ' || x, CASE s WHEN 1 THEN 'Paris, France' ELSE '' END FROM n WHERE s > 0""",
        "tex_authors": f"""
            WITH n AS (SELECT p_partkey AS doc_id, p_partkey % 5 AS s, {_X} AS x FROM part)
            SELECT doc_id, 0 AS ord, 'Ada ' || x AS name, CASE s WHEN 0 THEN 'Uni ' || x || '|Lab' WHEN 1 THEN 'Uni ' || x || '|City' WHEN 2 THEN 'Uni ' || x || '|Lab' ELSE 'Uni ' || x END AS affiliations FROM n
            UNION ALL SELECT doc_id, 1, 'Bob', CASE s WHEN 0 THEN 'Lab' WHEN 1 THEN 'Uni ' || x || '|City' WHEN 2 THEN 'Uni ' || x || '|Lab' WHEN 3 THEN 'Uni ' || x ELSE 'Lab' END FROM n""",
        "tex_documents": expected(
            content=(
                "## Abstract\n\nShort ‹size›.\n\n## 1 Intro ‹key›\n\nText **‹name›** [2,1] and $x^{‹size›}$.<sup>1</sup>\n\n[^1]\n\nnote ‹key›\n\nIncluded ‹name›.\n\n```\nprint(‹size›)\n```\n\nkept see [sec:i](#sec:i), [out](https://x.org), [https://y.org](https://y.org).\n\n"
                "$$\nE=‹size›c^2 \\tag{1}\n$$\n\nemph *a*\n\n$$\nz \\tag{2}\n$$\n\n*b*\n\n### Un\n\n- a\n- b\n  1. c\n\n### 1.1 Two\n\n| a | b |\n| --- | --- |\n| 1 | ‹name› |\n\n> Cap\n\n![](f)\n\n> Fig ‹key›\n\n```\ncode ‹size›\n```\n\n> said\n"),
            content_references="## References\n\n- [1] One.\n- [2] Two ‹key›.\n"),
        "tree_documents": expected(
            title="‹name›", authors="Ada", abstract="Short",
            content=(
                "## Head ‹key›\n\n*‹name›* **x** $y_{‹size›}$\n\n$$\nz \\tag{1}\n$$\n\n“q”<sup>1</sup>[k9][l](#a)`c`<sup>2</sup>~~s~~\nend\n\n[^1]\n\nnoted\n\n- one\n- two\n\n```python\nx = ‹size›\n```\n\n> quoted\n\n---\n\ninside\n\n![](‹key›.png)\n\n> Cap\n\n"
                "| h |\n| --- |\n| ‹name› |\n\nv1\nv2\n\n\\raw{‹size›}\n\n<!-- Strange -->\n")),
    }
