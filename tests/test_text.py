import pytest
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.functions.dom import parse
from quirework.operators import pages as P

L = F.lit


@pytest.fixture(scope="module")
def ev(spark):
    one = spark.range(1)
    return lambda c: one.select(c).first()[0]


def arr(*xs):
    return F.array(*map(F.lit, xs))


@pytest.mark.parametrize("given,want", [("  4.2. The  Méthod ", "the méthod"), ("A.1 Foo", "foo"), ("a. Foo", "foo"), ("A model", "a model"), ("", "")])
def test_normalized_title(ev, given, want):
    assert ev(T.normalized_title(L(given))) == want


def test_slug_and_file_names(ev):
    assert ev(T.slug(L("Été naïve-x! foo"))) == "été-naïve-x-foo"
    assert len(ev(T.slug(L("ab " * 60)))) == 60
    assert ev(T.file_stem(L("A: b/c  d é--x"))) == "A-bc-d-é-x"
    assert ev(T.file_stem(L("word " * 30), 20)) == "word-word-word-word"
    assert ev(T.basename(L("20170207"), L("My: Title"), L("arXiv"))) == "201702-arXiv-My-Title"
    assert len(ev(T.basename(L("20170207"), L("x" * 400), L("arXiv")))) <= 255


@pytest.mark.parametrize(
    "given,ident,error",
    [("arXiv:2101.00001v2", "2101.00001v2", None), ("https://arxiv.org/abs/2101.00001", "2101.00001", None), ("https://arxiv.org/pdf/hep-th/9901001.pdf", "hep-th/9901001", None),
     ("foo", None, "not an arXiv id"), ("", None, "empty input"), ("https://x.org/abs/2101.00001", None, "unsupported host")],
)
def test_arxiv_input(ev, given, ident, error):
    r = ev(T.arxiv_input(L(given)))
    assert (r["id"], r["error"]) == (ident, error)


@pytest.mark.parametrize("given,want", [("# c", "skip"), ("  ", "skip"), ("./a/p.html", "local_html"), ("~/x.tar.gz", "local_archive"), ("2101.00001", "arxiv"), ("what", "unknown")])
def test_input_kind(ev, given, want):
    assert ev(T.input_kind(L(given))) == want


@pytest.mark.parametrize("given,want", [("2021/1/5", "20210105"), ("5 May 2018", "20180505"), ("May 5, 2018", "20180505"), ("20170207", "20170207"), ("Jan 2020", "20200101"), ("x", None), (None, None)])
def test_parsed_date(ev, given, want):
    assert ev(T.parsed_date(L(given).cast("string"))) == want


def test_dates_of_ids_and_cache(ev):
    assert ev(T.date_of_id(L("1702.50001"))) == "20170201"
    assert ev(T.date_of_id(L("1713.50001"))) is None
    assert ev(T.cache_key(L("hep-th/9901001"), L(None).cast("string"))) == "hep-th_9901001__latest"
    old, now = L("2024-01-01").cast("timestamp"), L("2024-01-03").cast("timestamp")
    assert ev(T.is_fresh(old, now, 0)) is True
    assert ev(T.is_fresh(old, now, 86400)) is False
    assert ev(T.is_fresh(old, now, 200_000)) is True
    assert ev(T.is_fresh(L(None).cast("timestamp"), now, 86400)) is False


def test_numbers_and_lists(ev):
    assert [ev(T.human_count(L(n))) for n in (950, 12345, 1234567)] == ["950", "12.3k", "1.2M"]
    assert ev(T.distinct_ci(arr("MIT", "mit ", "X"))) == ["MIT", "X"]
    assert ev(T.without_contained(arr("MIT", "MIT, Cambridge"))) == ["MIT, Cambridge"]
    assert ev(T.fingerprint(arr("a", "b"))) == __import__("hashlib").sha256(b"a\nb\n").hexdigest()


@pytest.mark.parametrize("a,b,want", [("Doe, Jane", "jane doe", True), ("J.K. Doe", "J K  doe.", True), ("J. Doe", "Jane Doe", True), ("Jane Doe", "Jane Roe", False), ("", "", False)])
def test_names_match(ev, a, b, want):
    assert ev(T.names_match(L(a), L(b))) is want


def test_heuristics(ev):
    assert ev(T.looks_like_name(L("Jane Doe*"))) is True
    assert ev(T.looks_like_name(L("University of X"))) is False
    assert ev(T.looks_like_name(L(None).cast("string"))) is False
    assert ev(T.looks_like_affiliation(L("Paris, France"))) is True


def test_identifiers(ev):
    assert ev(T.identifiers(L("see 10.1000/ab.c. arXiv:2101.00001v2 PMID: 33 https://x.org/a"))) == {"arxiv": "2101.00001v2", "pmid": "33", "doi": "10.1000/ab.c"}
    assert ev(T.identifiers(L("https://x.org/a"))) == {"url": "https://x.org/a"}
    assert ev(T.identifiers(L("https://doi.org/"))) == {}


def test_fragments_and_math(ev):
    got = [P.link_kind(x)[1] for x in ("#S1.F2", "#A1.T3", "#S1.SS2", "#S4", "#alg1", "#A1.F1")]
    assert got == ["figure-2", "table-3", "section-1-2", "section-4", "algorithm-1", "A1.F1"]
    assert P.link_kind("x#bib.bib12") == ("citation", "ref-12")
    assert P.normal_tex("{ \\alpha \\displaystyle x \\mbox{if $y$ z} \n b") == "{\\alpha x \\text{if }y\\text{ z} b"
    assert [P.normal_tex(t) for t in (r"\alpha\color{red}x", "\\alpha%\nx", r"a\mbox{${}\perp\mkern-11.0mu\perp{}$}b", r"\text{a $x$ b $y$ c}")] == [r"\alpha x", r"\alpha x", r"a\perp \!\!\! \perp b", r"\text{a }x\text{ b }y\text{ c}"]
    assert ev(T.spaced_math(L("a$ x\\, $b $$y$$ and $z$."))) == "a $x$ b $$y$$ and $z$."
    # a number at the end stays without the dollar sign before it
    assert [ev(T.simple_display_math(L(x))) for x in ("x $ (3)", "\\hbox{$a$} \\$ 5", "u\\raisebox{1pt}{\\hbox to 0.0 pt{\\hss\\vbox to 0.0pt{\\hbox{$v$}\\vss}}}w")] == ["x (3)", "\\hbox{a} \\$ 5", "uvw"]
    assert P._equation(parse("<table><math alttext='$a$'></math><math alttext='b \\tag{1}'></math></table>"))[0] == "a b"


def test_markdown(ev):
    assert ev(T.md_table(F.array(arr("a", "b|c"), arr("1")))) == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"
    assert ev(T.numbered_references(L("x\n- a\n- b"))) == 'x\n- <a id="ref-1"></a>[1] a\n- <a id="ref-2"></a>[2] b'
    assert ev(T.tidy_markdown(L("a  \n\n\n\nb"))) == "a\n\nb\n"
    assert ev(T.formatted_markdown(L('<a id="x"></a>\ntext\n- • b'), False)).strip() == "text\n- b"
    assert ev(T.md_escape(L("a[b]\\c"))) == "a\\[b\\]\\\\c"


def test_bibtex(ev):
    assert ev(T.bibtex_escape(L("a_b & {c}"))) == "a\\_b \\& \\{c\\}"
    assert ev(T.citation_key(arr("Jane Doe"), L("2020"), L("T"))) == "doe2020"
    assert ev(T.citation_key(F.expr("array()").cast("array<string>"), L("2020"), L("Big deal"))) == "2020big"
    assert ev(T.bibtex_authors(arr("Jane M. Doe", "X, Y"))) == "Doe, Jane M. and X, Y"
    assert ev(T.bibtex_entry(L("article"), L("k"), {"title": L("T"), "booktitle": L("B"), "doi": L(None).cast("string")})) == "@article{k,\n  title = {T}\n}"
    assert ev(T.short_citation(arr("A", "B", "C"), L("2020"), L("t" * 70))) == "A et al.. (2020). " + "t" * 57 + "...."
    assert ev(T.short_citation(arr("A", "B"), L(None).cast("string"), L("T"), L("2101.00001"))) == "A and B. T. arXiv:2101.00001." and ev(T.short_citation(arr(), L("2020"), L("T"))) == ""
    assert ev(T.paper_bibtex(arr("Jane Doe", "X, Y"), L("2020"), L("{T}"), L("2101.00001v2"), L("cs.CL"), L(""))).splitlines() == ["@misc{doe20202101,", "  author = {Doe, Jane and X, Y},", "  title = {{{T}}},", "  year = {2020},", "  eprint = {2101.00001},", "  archivePrefix = {arXiv},", "  primaryClass = {cs.CL},", "}"]
    assert ev(T.bibtex_escape(L("a^b~c%"))) == "a\\^{}b\\textasciitilde{}c\\%"


def test_listings(ev):
    assert ev(T.listing_text(L("data:text/plain;charset=utf-8;base64,aGk="))) == "hi"
    assert ev(T.listing_text(L("zz"))) in (None, "")
