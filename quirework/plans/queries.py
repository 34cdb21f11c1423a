"""Named queries of the core over the test tables, each with SQL that says the same without the operator.

Where no table holds a kind of input, markup is built from base columns, the operator reads it, and the SQL derives the
answer from the base columns. Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.session import table
from ..operators import citations as C
from ..operators import graph as G
from ..operators import images as I
from ..operators import metadata as M
from ..operators import nested, traverse
from ..operators import numbering as N
from ..operators import outline as O
from ..operators import pages as P
from ..sources import inputs
from . import batch, markup_queries, source_queries
from . import pipeline as PL

Query = Callable[[SparkSession, str], DataFrame]


#: Places of a customer's years are this far apart.
BASE = 10_000_000_000


def _html_text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def document_pages(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, html): documents as pages, one paragraph a line."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<p>"), _html_text(x), F.lit("</p>")))
    head = F.concat(F.lit('<article class="ltx_document"><h1 class="ltx_title ltx_title_document">Document '), F.col("doc_id").cast("string"), F.lit('</h1><section class="ltx_section" id="S1"><h2>'), _html_text(F.coalesce("section_title", F.lit("Text"))), F.lit("</h2>"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.concat(head, F.array_join(lines, ""), F.lit("</section></article>")).alias("html"))


def orders_tree(spark: SparkSession, d: str) -> DataFrame:
    """A customer's years as top sections, the orders of a year as subsections."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id"), F.year("o_orderdate").cast("long").alias("k"), "o_orderkey").agg(F.min("o_orderpriority").alias("o_orderpriority"))
    top = o.select("doc_id", "k").distinct().select("doc_id", (F.col("k") * BASE).alias("pos"), F.lit(1).alias("level"), F.col("k").cast("string").alias("title"))
    sub = o.select("doc_id", (F.col("k") * BASE + 1 + F.col("o_orderkey")).alias("pos"), F.lit(2).alias("level"), F.col("o_orderpriority").alias("title"))
    return top.unionByName(sub).withColumn("unnumbered", F.lit(False)).withColumn("struct_id", F.lit(None).cast("string"))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return O.with_paths(O.with_parents(orders_tree(spark, d)))


_TREE_SQL = f"""tree AS (
  SELECT DISTINCT o_custkey AS doc_id, year(o_orderdate) * {BASE}::BIGINT AS pos, 1 AS level, year(o_orderdate) || '' AS title, NULL AS parent_pos, year(o_orderdate) AS k, 0 AS n FROM orders
  UNION ALL SELECT o_custkey, year(o_orderdate) * {BASE}::BIGINT + 1 + o_orderkey, 2, min(o_orderpriority), year(o_orderdate) * {BASE}::BIGINT, year(o_orderdate), o_orderkey + 1 FROM orders GROUP BY o_custkey, year(o_orderdate), o_orderkey)"""


def section_parents(spark, d):
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), (1 + (F.col("o_orderkey") * 7 + F.col("o_custkey")) % 6).cast("int").alias("level"))
    return O.with_parents(s).select("doc_id", "pos", "level", F.col("parent_pos").cast("long").alias("parent_pos"))


def section_numbers(spark, d):
    return O.section_numbers(_tree(spark, d)).select("doc_id", "pos", "number")


def section_ids(spark, d):
    return O.with_struct_ids(_tree(spark, d)).select("doc_id", "pos", "struct_id")


def section_tree(spark, d):
    return O.printed_tree(_tree(spark, d))


def tree_filter_include(spark, d):
    return O.filter_tree(_tree(spark, d), "include", ["1995", "1-URGENT"]).select("doc_id", "pos", "title")


def tree_filter_exclude(spark, d):
    return O.filter_tree(_tree(spark, d), "exclude", ["1995", "1-URGENT"]).select("doc_id", "pos", "title")


def content_filter_include(spark, d):
    return O.filter_content(_tree(spark, d), "include", ["1995", "1-URGENT"]).select("doc_id", "pos", "title")


def split_parts(spark, d):
    title = F.when(F.col("o_orderpriority") == "5-LOW", "7. References").when(F.col("o_orderpriority") == "2-HIGH", "Appendix A").otherwise("Body")
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.lit(1).alias("level"), title.alias("title"))
    return O.split_parts(s.withColumn("path", F.array("pos"))).select("doc_id", "pos", "part")


def normalized_titles(spark, d):
    made = F.concat(F.lit("  "), (F.col("p_size")).cast("string"), F.lit(".2.  "), F.upper("p_name"), F.lit(" "))
    return table(spark, d, "part").select("p_partkey", T.normalized_title(made).alias("title"))


def title_slugs(spark, d):
    return table(spark, d, "papers").filter("title is not null").select("paper_id", T.slug(F.col("title")).alias("slug"))


def output_names(spark, d):
    return table(spark, d, "papers").filter("title is not null").select("paper_id", T.basename(T.parsed_date(F.col("submission_date")), F.col("title"), F.lit("arXiv")).alias("name"))


def submission_dates(spark, d):
    return table(spark, d, "papers").select("paper_id", T.parsed_date(F.col("submission_date")).alias("day"))


def id_dates(spark, d):
    return table(spark, d, "papers").select("paper_id", T.date_of_id(F.col("arxiv_id")).alias("day"))


def arxiv_inputs(spark, d):
    p = table(spark, d, "papers").select("paper_id", "arxiv_id", F.coalesce("arxiv_version", F.lit("")).alias("v"), "html_url")
    spelled = F.array(F.concat(F.lit("arXiv:"), "arxiv_id", "v"), F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id", "v"), F.concat(F.lit(" https://arxiv.org/pdf/"), "arxiv_id", "v", F.lit(".pdf")), F.col("html_url"), F.concat(F.lit("x"), "arxiv_id"))
    s = p.select("paper_id", F.posexplode(spelled).alias("form", "text"))
    return s.select("paper_id", "form", T.arxiv_input(F.col("text")).alias("a")).select("paper_id", "form", "a.base", "a.version", F.col("a.error").isNotNull().alias("failed"))


def reference_ids(spark, d):
    c = table(spark, d, "citations")
    text = F.concat_ws(" ", F.coalesce("raw_text", F.lit("")), "doi", "url", F.concat(F.lit("arXiv:"), "arxiv_id"))
    ids = c.select("citation_id", T.identifiers(text).alias("m"))
    return ids.select("citation_id", F.col("m")["doi"].alias("doi"), F.col("m")["arxiv"].alias("arxiv"), F.col("m")["url"].alias("url"))


def text_references(spark, d):
    return C.from_text(table(spark, d, "documents")).select("doc_id", F.col("ord").cast("long").alias("ord"), "key", "text")


def bibtex_entries(spark, d):
    c = table(spark, d, "citations").withColumnRenamed("pub_year", "year").withColumn("ord", F.col("citation_id"))
    return C.bibtex(c, "citation_id").select("citation_id", "key", "entry")


def block_numbers(spark, d):
    kind = F.when(F.col("o_orderpriority") < "3", "figure").when(F.col("o_orderpriority") < "5", "table").otherwise("equation")
    own = F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 4 + 1).cast("int"))
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), kind.alias("kind"), own.alias("claimed"))
    return N.number_blocks(b).select("doc_id", "pos", "kind", F.col("number").cast("long").alias("number"))


def block_anchors(spark, d):
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("figure-"), F.lower("o_orderstatus")).alias("base"))
    return N.unique_anchors(b).select("doc_id", "pos", "anchor")


def fragment_links(spark, d):
    o = table(spark, d, "orders")
    blocks = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("L"), (F.col("o_orderkey") % 5).cast("string")).alias("label"), F.concat(F.lit("a-"), F.col("o_orderkey").cast("string")).alias("anchor"))
    links = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("link"), F.concat(F.lit("L"), (F.col("o_orderkey") % 7).cast("string")).alias("target_id"))
    return N.point_links(links, blocks).select("doc_id", "link", "target")


def figure_order(spark, d):
    fig = F.col("o_orderstatus") == "O"
    b = table(spark, d, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.lit(0).alias("scope"), F.col("o_orderkey").alias("pos"), F.when(fig, "figure").otherwise("paragraph").alias("kind"),
        F.when(fig, F.lit(None).cast("string")).otherwise(F.concat(F.lit("see Fig. "), (F.floor(F.col("o_orderkey") / 7) % 6 + 1).cast("string"))).alias("text"), F.when(fig, F.col("o_orderkey") % 6 + 1).cast("int").alias("number"),
    )
    return N.reorder_figures(b).select("doc_id", "pos", F.col("new_pos").cast("long").alias("new_pos"))


def _paper_graph(spark, d):
    t = _tree(spark, d).withColumn("struct_id", F.col("pos").cast("string"))
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("title"))
    o = table(spark, d, "orders")
    blocks = o.dropDuplicates(["o_custkey", "o_orderkey"]).select(F.col("o_custkey").alias("doc_id"), (F.year("o_orderdate").cast("long") * BASE).cast("string").alias("section"), F.col("o_orderkey").alias("index"), F.lit("paragraph").alias("kind"), F.col("o_orderstatus").alias("text"))
    assets = o.select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("img/"), "o_orderpriority").alias("path"), F.lit("image").alias("kind"))
    return G.graph(docs, t, blocks, assets)


def graph_nodes(spark, d):
    return _paper_graph(spark, d)[0].groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def graph_edges(spark, d):
    return _paper_graph(spark, d)[1].select("doc_id", "src", "dst", "type")


def block_ids(spark, d):
    return table(spark, d, "blocks").select("block_row_id", G.block_ids(F.col("section_struct_id"), F.col("order_index"), F.col("block_type")).alias("id"))


def content_hashes(spark, d):
    s = table(spark, d, "sections").filter("markdown is not null")
    return s.select("section_id", T.fingerprint(F.array(F.coalesce("title", F.lit("")), "markdown")).alias("sha256"))


def distinct_affiliations(spark, d):
    return table(spark, d, "paper_authors").filter("affiliations is not null").select("author_id", F.array_join(T.distinct_ci(F.col("affiliations")), "|").alias("affiliations"))


def author_matches(spark, d):
    authors = table(spark, d, "papers").filter("authors is not null").select(F.col("paper_id").alias("doc_id"), "arxiv_id", F.posexplode("authors").alias("ord", "name"))
    pa = table(spark, d, "paper_authors").select("arxiv_id", F.col("author_id").alias("ord"), F.col("author_name").alias("name"), "affiliations")
    candidates = authors.select("doc_id", "arxiv_id").distinct().join(pa, "arxiv_id").drop("arxiv_id")
    return M.first_matches(authors.drop("arxiv_id"), candidates, True).select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("c_ord").alias("author_id"))


def region_tables(spark, d):
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.array(F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.col("n_name")))).alias("r"))
    rows = F.concat(F.array(F.array(F.lit("key"), F.lit("a|b"), F.lit("note"))), F.col("r"))
    return n.select("n_regionkey", rows.alias("rows")).select("n_regionkey", T.md_table(F.col("rows")).alias("md"))


def reference_numbers(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: F.concat(F.lit("- "), x["o_orderpriority"])), "\n").alias("t"))
    return o.select("o_custkey", T.numbered_references(F.col("t")).alias("md"))


def size_labels(spark, d):
    return table(spark, d, "documents").select("doc_id", T.human_count(F.col("n_chars") * 37).alias("label"))


def author_heuristics(spark, d):
    p = table(spark, d, "paper_authors")
    words = p.select("author_id", F.explode(F.concat(F.array("author_name"), F.coalesce("affiliations", F.expr("cast(array() as array<string>)")))).alias("t")).filter("t is not null")
    return words.select("author_id", "t", T.looks_like_name(F.col("t")).alias("is_name"), T.looks_like_affiliation(F.col("t")).alias("is_affiliation"))


def listing_payloads(spark, d):
    t = table(spark, d, "documents").filter("text is not null")
    href = F.concat(F.lit("data:text/plain;charset=utf-8;base64,"), F.replace(F.base64(F.encode("text", "utf-8")), F.lit("\r\n"), F.lit("")))
    return t.select("doc_id", F.sha2(T.listing_text(href), 256).alias("sha256"))


def batch_report(spark, d):
    p = table(spark, d, "papers")
    line = F.when(F.col("paper_id") % 5 == 0, F.lit("# note")).when(F.col("paper_id") % 7 == 0, F.lit("  ")).when(F.col("paper_id") % 11 == 0, F.lit("no id")).otherwise(F.col("arxiv_id"))
    lines = inputs.classify(p.select(line.alias("line")))
    return lines.withColumn("status", F.when(F.col("kind") == "skip", "skip").when(F.col("error").isNull(), "ok").otherwise("error")).groupBy("status").agg(F.count("*").alias("n"))


def page_blocks(spark, d):
    parsed = P.parse_pages(document_pages(spark, d))
    b = P.blocks_of(parsed)
    return b.filter("kind = 'paragraph'").groupBy("doc_id").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "text")))["text"], "\n"), 256).alias("sha256"))


def page_sections(spark, d):
    parsed = P.parse_pages(document_pages(spark, d))
    return parsed.select("doc_id", "title", F.size("sections").alias("n_sections"), F.get("sections", F.lit(0))["title"].alias("first_title"))


def page_nodes(spark, d):
    tree = traverse.nodes(P.parse_pages(document_pages(spark, d)))
    return traverse.counts(tree.filter("type in ('document', 'section', 'paragraph', 'author')"))


def section_pages(spark, d):
    """Blocks by kind of the stored sections' own markup."""
    s = table(spark, d, "sections").filter("html is not null")
    return P.blocks_of(P.parse_pages(s, "section_id")).groupBy("kind").agg(F.count("*").alias("n"))


def section_headings(spark, d):
    s = table(spark, d, "sections").filter("html is not null")
    first = F.get("sections", F.lit(0))
    return P.parse_pages(s, "section_id").select(F.col("doc_id").alias("section_id"), F.size("sections").alias("n"), first["level"].alias("level"))


def paper_markdown(spark, d):
    """Whole plan over the stored sections: Markdown of each."""
    s = table(spark, d, "sections").filter("html is not null")
    return PL.to_markdown(PL.convert(s, "section_id")).select(F.col("doc_id").alias("section_id"), "content")


def document_markdown(spark, d):
    """Whole plan over documents as pages: tree, Markdown in its parts and its hash. Signs that Markdown escapes or reads as formulas are replaced before."""
    pages = document_pages(spark, d).select("doc_id", F.translate("html", "$\\[]", "S/()").alias("html"))
    return batch.ingest(pages).select("doc_id", "title", "sections_tree", "content", "content_references", "content_appendix", "sha256")


def page_images(spark, d):
    html = F.concat(F.lit('<section><h2>x</h2><figure class="ltx_figure"><img src="'), F.col("p_name"), F.lit('.png"><figcaption>Figure '), F.col("p_size").cast("string"), F.lit(": y</figcaption></figure></section>"))
    return batch.images_only(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), html.alias("html"))).select("doc_id", "src")


def tex_images(spark, d):
    text = F.concat(F.lit("\\includegraphics[width=1cm]{fig/"), F.col("p_brand"), F.lit("}\n% \\includegraphics{no}\n\\begin{overpic}[a]{"), F.col("p_type"), F.lit("}\\end{overpic}"))
    return I.image_references(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))).select("doc_id", F.col("ord").cast("long").alias("ord"), "ref")


_QUERIES: list[Query] = [
    section_parents, section_numbers, section_ids, section_tree, tree_filter_include, tree_filter_exclude, content_filter_include, split_parts, normalized_titles, title_slugs, output_names, submission_dates, id_dates, arxiv_inputs,
    reference_ids, text_references, bibtex_entries, block_numbers, block_anchors, fragment_links, figure_order, graph_nodes, graph_edges, block_ids, content_hashes, distinct_affiliations, author_matches, region_tables, reference_numbers,
    size_labels, author_heuristics, listing_payloads, batch_report, page_blocks, page_sections, page_nodes, section_pages, section_headings, paper_markdown, document_markdown, page_images, tex_images,
]


def queries() -> dict[str, Query]:
    return {"p6_found": nested.found} | {q.__name__: q for q in [*_QUERIES, *markup_queries.QUERIES, *source_queries.QUERIES]}


_WS = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{001c}-\x{001f}\x{000b}]+"
_SLUG = r"regexp_replace(trim(regexp_replace({0}, '[^\p{{L}}\p{{N}}\p{{M}}_\s-]', '', 'g')), '\s+', '-', 'g')"
_STEM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[^\p{{L}}\p{{N}} _-]', '', 'g'), ' +', '-', 'g'), '-{{2,}}', '-', 'g'), '^-+|-+$', '', 'g')"
_DAY = r"""coalesce(
  CASE WHEN regexp_matches(s, '\d{4}[-/]\d{1,2}[-/]\d{1,2}') THEN regexp_extract(s, '(\d{4})[-/](\d{1,2})[-/](\d{1,2})', 1) || lpad(regexp_extract(s, '(\d{4})[-/](\d{1,2})[-/](\d{1,2})', 2), 2, '0') || lpad(regexp_extract(s, '(\d{4})[-/](\d{1,2})[-/](\d{1,2})', 3), 2, '0') END,
  CASE WHEN regexp_matches(s, '^\d{8}$') THEN s END, strftime(try_strptime(s, ['%d %B %Y', '%d %b %Y', '%B %d, %Y', '%b %d, %Y']), '%Y%m%d'),
  strftime(try_strptime('1 ' || s, ['%d %B %Y', '%d %b %Y']), '%Y%m%d'))"""
#: What the SQL takes from itself, so that a wrong entry in the library shows.
_WORDS = (
    "(?i)university|college|institute|institution|laboratory|lab|school|center|centre|department|faculty|division|academy|consortium|corporation|corp|inc|ltd|gmbh|research|google|microsoft|meta|amazon|apple|deepmind|openai|anthropic|"
    "nvidia|intel|ibm|facebook|twitter|tesla|uber|lyft|airbnb|netflix|stripe|square|berkeley|stanford|mit|harvard|caltech|cmu|princeton|yale|columbia|cornell|oxford|cambridge|eth|epfl|mpi|inria|cern|nasa|flatiron|allen|astera"
)


def _escaped(c: str) -> str:
    for a, b in (("\\", "\\textbackslash{}"), ("{", "\\{"), ("}", "\\}"), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"), ("^", "\\^{}"), ("~", "\\textasciitilde{}")):
        c = f"replace({c}, '{a}', '{b}')"
    return c


def _bib_sql() -> str:
    def field(name: str, value: str, only: str = "TRUE", raw: bool = False) -> str:
        return f"CASE WHEN {value} IS NOT NULL AND {value} <> '' AND {only} THEN '  {name} = {{' || {value if raw else _escaped(value)} || '}}' END"

    fields = [
        field("title", "title"), field("author", "author_text"), field("year", "pub_year"), field("journal", "journal", "entry_type = 'article'"), field("booktitle", "booktitle", "entry_type IN ('inproceedings', 'incollection')"), field("volume", "volume"),
        field("number", "issue"), field("pages", "pages"), field("doi", "doi", raw=True), field("url", "url", raw=True), field("publisher", "publisher"), field("abstract", "abstract"), field("note", "note"),
    ]
    ws = _WS
    squeeze = lambda x: f"trim(regexp_replace({x}, '{ws}', ' ', 'g'))"
    return rf"""
    WITH a AS (SELECT *, list_filter(authors, lambda x: {squeeze('x')} <> '') AS au FROM citations),
    b AS (SELECT *, CASE WHEN au IS NULL THEN NULL ELSE array_to_string(list_transform(au, lambda x: CASE WHEN contains(x, ',') OR NOT contains({squeeze('x')}, ' ')
        THEN regexp_replace(x, '^{ws}|{ws}$', '', 'g') ELSE split_part({squeeze('x')}, ' ', -1) || ', ' || regexp_extract({squeeze('x')}, '^(.*) \S+$', 1) END), ' and ') END AS author_text, au[1] AS f FROM a),
    c AS (SELECT *, concat(regexp_replace(CASE WHEN contains(f, ',') THEN split_part(f, ',', 1) ELSE split_part({squeeze('f')}, ' ', -1) END, '[^\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}]', '', 'g'), pub_year,
        CASE WHEN f IS NULL THEN regexp_replace(split_part({squeeze('title')}, ' ', 1), '[^\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}]', '', 'g') END) AS k FROM b)
    SELECT citation_id, lower(CASE WHEN k <> '' THEN k ELSE 'ref0' END) AS key, '@' || coalesce(entry_type, 'misc') || '{{' || lower(CASE WHEN k <> '' THEN k ELSE 'ref0' END) || ',' || chr(10)
        || coalesce(array_to_string(list_filter([{', '.join(fields)}], lambda x: x IS NOT NULL), ',' || chr(10)), '') || chr(10) || '}}' AS entry FROM c"""


def oracle_sql() -> dict[str, str]:
    q = {
        "section_parents": """
            WITH s AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, CAST(1 + (o_orderkey * 7 + o_custkey) % 6 AS INT) AS level FROM orders)
            SELECT a.doc_id, a.pos, a.level, max(b.pos)::BIGINT AS parent_pos FROM s a LEFT JOIN s b ON b.doc_id = a.doc_id AND b.pos < a.pos AND b.level < a.level GROUP BY ALL""",
        "section_numbers": f"""
            WITH {_TREE_SQL}, o AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY k) AS a, row_number() OVER (PARTITION BY doc_id, k ORDER BY n) - 1 AS b FROM tree)
            SELECT doc_id, pos, CASE WHEN n = 0 THEN a || '' ELSE a || '.' || b END AS number FROM o""",
        "section_ids": f"""
            WITH {_TREE_SQL}, o AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS a, row_number() OVER (PARTITION BY doc_id, k ORDER BY n) - 2 AS b FROM tree)
            SELECT doc_id, pos, CASE WHEN n = 0 THEN 'sec_' || a ELSE 'sec_' || a || '_' || b END AS struct_id FROM o""",
        "section_tree": f"WITH {_TREE_SQL} SELECT doc_id, string_agg(CASE WHEN level = 2 THEN '    ' ELSE '' END || title, chr(10) ORDER BY pos) AS tree FROM tree GROUP BY doc_id",
        "tree_filter_include": f"""
            WITH {_TREE_SQL}, hit AS (SELECT * FROM tree WHERE title IN ('1995', '1-URGENT'))
            SELECT doc_id, pos, title FROM tree t WHERE EXISTS (SELECT 1 FROM hit h WHERE h.doc_id = t.doc_id AND (h.pos = t.pos OR h.pos = t.parent_pos OR h.parent_pos = t.pos))""",
        "tree_filter_exclude": f"""
            WITH {_TREE_SQL}, hit AS (SELECT * FROM tree WHERE title IN ('1995', '1-URGENT'))
            SELECT doc_id, pos, title FROM tree t WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.doc_id = t.doc_id AND (h.pos = t.pos OR h.pos = t.parent_pos))""",
        "content_filter_include": f"""
            WITH {_TREE_SQL} SELECT doc_id, pos, title FROM tree WHERE title = '1995'
            UNION ALL SELECT doc_id, pos, title FROM tree WHERE level = 2 AND k = 1995 AND title = '1-URGENT'""",
        "split_parts": """
            WITH m AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, min(CASE WHEN o_orderpriority = '5-LOW' THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS r, min(CASE WHEN o_orderpriority = '2-HIGH' THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS a FROM orders)
            SELECT doc_id, pos, CASE WHEN r IS NOT NULL THEN CASE WHEN pos < r THEN 'main' WHEN pos = r THEN 'references' ELSE 'appendix' END WHEN pos >= a THEN 'appendix' ELSE 'main' END AS part FROM m""",
        "normalized_titles": "SELECT p_partkey, lower(p_name) AS title FROM part",
        "title_slugs": f"SELECT paper_id, substr({_SLUG.format('lower(title)')}, 1, 60) AS slug FROM papers WHERE title IS NOT NULL",
        "output_names": f"""
            WITH d AS (SELECT paper_id, trim(submission_date) AS s, {_STEM.format('title')} AS t FROM papers WHERE title IS NOT NULL)
            SELECT paper_id, concat_ws('-', substr({_DAY}, 1, 6), 'arXiv', t) AS name FROM d""",
        "submission_dates": f"WITH d AS (SELECT paper_id, trim(submission_date) AS s FROM papers) SELECT paper_id, {_DAY} AS day FROM d",
        "id_dates": r"SELECT paper_id, CASE WHEN regexp_matches(arxiv_id, '^\d{2}(0[1-9]|1[0-2])\.\d{4,5}') THEN '20' || substr(arxiv_id, 1, 4) || '01' END AS day FROM papers",
        "arxiv_inputs": "SELECT paper_id, f::INT AS form, CASE WHEN f < 3 THEN arxiv_id END AS base, CASE WHEN f < 3 THEN arxiv_version END AS version, f >= 3 AS failed FROM papers, range(5) r(f)",
        "reference_ids": r"""
            WITH t AS (SELECT citation_id, concat_ws(' ', coalesce(raw_text, ''), doi, url, 'arXiv:' || arxiv_id) AS s FROM citations),
            x AS (SELECT citation_id, s, nullif(regexp_replace(regexp_extract(s, '(?i)10\.\d{4,}/[^\s"''<>]+'), '\.+$', ''), '') AS doi, nullif(regexp_extract(s, '(?i)arXiv:(\d{4}\.\d{4,}(?:v\d+)?)', 1), '') AS arxiv, nullif(regexp_extract(s, '(?i)https?://[^\s<>"'']+'), '') AS u FROM t)
            SELECT citation_id, doi, arxiv, CASE WHEN doi IS NULL AND NOT starts_with(u, 'https://doi.org/') THEN u END AS url FROM x""",
        "text_references": r"""
            WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
            k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) = 1 OR regexp_matches(line, '^\s*(?:\[\d+\]|\d+\.\s|\p{Lu}[\p{L}''’-]+,)') AS b FROM l WHERE trim(line) <> ''),
            e AS (SELECT *, sum(b::INT) OVER (PARTITION BY doc_id ORDER BY n) AS o FROM k)
            SELECT doc_id, o::BIGINT AS ord, 'ref' || o AS key, string_agg(trim(line), ' ' ORDER BY n) AS text FROM e GROUP BY doc_id, o""",
        "bibtex_entries": _bib_sql(),
        "block_numbers": """
            WITH b AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, CASE WHEN o_orderpriority < '3' THEN 'figure' WHEN o_orderpriority < '5' THEN 'table' ELSE 'equation' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 + 1 END AS c FROM orders),
            k AS (SELECT *, sum((c IS NULL OR kind = 'equation')::INT) OVER (PARTITION BY doc_id, kind ORDER BY pos) AS k FROM b),
            taken AS (SELECT DISTINCT doc_id, kind, c FROM b WHERE c IS NOT NULL AND kind <> 'equation'),
            top AS (SELECT doc_id, kind, max(k) + 4 AS m FROM k GROUP BY ALL),
            free AS (SELECT t.doc_id, t.kind, i, row_number() OVER (PARTITION BY t.doc_id, t.kind ORDER BY i) AS k FROM top t, LATERAL (SELECT unnest(range(1, t.m::BIGINT + 1)) AS i) r
                     WHERE NOT EXISTS (SELECT 1 FROM taken x WHERE x.doc_id = t.doc_id AND x.kind = t.kind AND x.c = i))
            SELECT k.doc_id, k.pos, k.kind, (CASE WHEN k.kind = 'equation' THEN k.k WHEN k.c IS NOT NULL THEN k.c ELSE f.i END)::BIGINT AS number FROM k LEFT JOIN free f ON f.doc_id = k.doc_id AND f.kind = k.kind AND f.k = k.k""",
        "block_anchors": """
            WITH n AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, 'figure-' || lower(o_orderstatus) AS b, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders)
            SELECT doc_id, pos, CASE WHEN n = 1 THEN b ELSE b || '-' || n END AS anchor FROM n""",
        "fragment_links": """
            WITH t AS (SELECT o_custkey, 'L' || (o_orderkey % 5) AS label, max(o_orderkey) AS m FROM orders GROUP BY ALL)
            SELECT l.o_custkey AS doc_id, l.o_orderkey AS link, coalesce('a-' || t.m, 'L' || (l.o_orderkey % 7)) AS target FROM orders l LEFT JOIN t ON t.o_custkey = l.o_custkey AND t.label = 'L' || (l.o_orderkey % 7)""",
        "figure_order": """
            WITH b AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, o_orderstatus = 'O' AS fig, o_orderkey % 6 + 1 AS num, (o_orderkey // 7) % 6 + 1 AS cites FROM orders),
            f AS (SELECT doc_id, cites, min(pos) AS first FROM b WHERE NOT fig GROUP BY ALL),
            m AS (SELECT b.*, b.fig AND f.first < b.pos AS moves, f.first FROM b LEFT JOIN f ON f.doc_id = b.doc_id AND f.cites = b.num)
            SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN moves THEN first ELSE pos END, coalesce(moves, FALSE)::INT, CASE WHEN moves THEN -pos ELSE 0 END) AS new_pos FROM m""",
        "graph_nodes": f"""
            WITH {_TREE_SQL} SELECT c_custkey AS doc_id, 'paper' AS type, 1 AS n, 'paper:' || c_custkey AS first_id FROM customer
            UNION ALL SELECT doc_id, 'section', count(*), min('section:' || doc_id || ':' || pos) FROM tree GROUP BY doc_id
            UNION ALL SELECT o_custkey, 'block', count(DISTINCT o_orderkey), min('block:' || o_custkey || ':' || (year(o_orderdate) * {BASE}::BIGINT) || ':b' || o_orderkey || ':paragraph') FROM orders GROUP BY o_custkey
            UNION ALL SELECT o_custkey, 'asset', count(DISTINCT o_orderpriority), min('asset:img/' || o_orderpriority) FROM orders GROUP BY o_custkey""",
        "graph_edges": f"""
            WITH {_TREE_SQL}, s AS (SELECT *, 'section:' || doc_id || ':' || pos AS id FROM tree),
            b AS (SELECT DISTINCT o_custkey AS doc_id, year(o_orderdate) * {BASE}::BIGINT AS sec, o_orderkey AS i, 'block:' || o_custkey || ':' || (year(o_orderdate) * {BASE}::BIGINT) || ':b' || o_orderkey || ':paragraph' AS id FROM orders)
            SELECT doc_id, 'paper:' || doc_id AS src, id AS dst, 'contains' AS type FROM s WHERE level = 1
            UNION ALL SELECT doc_id, 'section:' || doc_id || ':' || sec, id, 'contains' FROM b
            UNION ALL SELECT DISTINCT o_custkey, 'paper:' || o_custkey, 'asset:img/' || o_orderpriority, 'contains' FROM orders
            UNION ALL SELECT doc_id, 'section:' || doc_id || ':' || parent_pos, id, 'child_section' FROM s WHERE level = 2
            UNION ALL SELECT * FROM (SELECT doc_id, lag(id) OVER (PARTITION BY doc_id ORDER BY pos) AS src, id, 'next' FROM s) WHERE src IS NOT NULL
            UNION ALL SELECT * FROM (SELECT doc_id, lag(id) OVER (PARTITION BY doc_id, sec ORDER BY i) AS src, id, 'next' FROM b) WHERE src IS NOT NULL""",
        "block_ids": "SELECT block_row_id, section_struct_id || ':b' || order_index || ':' || block_type AS id FROM blocks",
        "content_hashes": "SELECT section_id, sha256(concat(title, chr(10), markdown, chr(10))) AS sha256 FROM sections WHERE markdown IS NOT NULL",
        "document_markdown": rf"""
            WITH t AS (SELECT doc_id, translate(text, '$\[]', 'S/()') AS text, trim(regexp_replace(translate(coalesce(section_title, 'Text'), '$\[]', 'S/()'), '{_WS}', ' ', 'g')) AS h FROM documents WHERE text IS NOT NULL),
            l AS (SELECT doc_id, h, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM t),
            s AS (SELECT doc_id, h, n, trim(regexp_replace(line, '{_WS}', ' ', 'g')) AS p FROM l),
            d AS (SELECT doc_id, h, string_agg(p, chr(10) || chr(10) ORDER BY n) FILTER (WHERE p <> '') AS body, lower(trim(regexp_replace(h, '^[\d.]+\s+', ''))) AS k FROM s GROUP BY doc_id, h),
            m AS (SELECT *, CASE WHEN body IS NULL THEN NULL WHEN k IN ('references', 'bibliography') THEN 'r' WHEN starts_with(k, 'appendix') THEN 'a' ELSE 'm' END AS part, regexp_replace(concat('## ', h, chr(10), chr(10), body, chr(10)), '(?m)^(\s*-\s+)[•·◦]\s+', '', 'g') AS md FROM d)
            SELECT doc_id, 'Document ' || doc_id AS title, CASE WHEN body IS NOT NULL THEN h END AS sections_tree, CASE part WHEN 'm' THEN md END AS content, CASE part WHEN 'r' THEN md END AS content_references, CASE part WHEN 'a' THEN md END AS content_appendix,
            CASE WHEN body IS NOT NULL THEN sha256(body || chr(10)) END AS sha256 FROM m""",
        "distinct_affiliations": rf"""
            WITH u AS (SELECT author_id, regexp_replace(unnest(affiliations), '^{_WS}|{_WS}$', '', 'g') AS a, generate_subscripts(affiliations, 1) AS i FROM paper_authors WHERE affiliations IS NOT NULL),
            f AS (SELECT author_id, lower(a) AS k, min(i) AS i, arg_min(a, i) AS a FROM u WHERE a <> '' GROUP BY author_id, lower(a))
            SELECT p.author_id, coalesce(string_agg(f.a, '|' ORDER BY f.i), '') AS affiliations FROM paper_authors p LEFT JOIN f ON f.author_id = p.author_id WHERE p.affiliations IS NOT NULL GROUP BY p.author_id""",
        "author_matches": rf"""
            WITH n AS (SELECT paper_id AS doc_id, arxiv_id, unnest(authors) AS name, generate_subscripts(authors, 1) - 1 AS ord FROM papers WHERE authors IS NOT NULL),
            l AS (SELECT doc_id, arxiv_id, ord, lower(CASE WHEN contains(name, ',') THEN regexp_replace(split_part(name, ',', 1), '^{_WS}|{_WS}$', '', 'g') ELSE split_part(trim(regexp_replace(name, '{_WS}', ' ', 'g')), ' ', -1) END) AS k FROM n),
            c AS (SELECT arxiv_id, author_id, lower(CASE WHEN contains(author_name, ',') THEN regexp_replace(split_part(author_name, ',', 1), '^{_WS}|{_WS}$', '', 'g') ELSE split_part(trim(regexp_replace(author_name, '{_WS}', ' ', 'g')), ' ', -1) END) AS k FROM paper_authors WHERE len(affiliations) > 0)
            SELECT l.doc_id, l.ord::BIGINT AS ord, min(c.author_id) AS author_id FROM l LEFT JOIN c ON c.arxiv_id = l.arxiv_id AND c.k = l.k GROUP BY ALL""",
        "region_tables": r"SELECT n_regionkey, '| key | a\|b | note |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || lpad(n_nationkey::VARCHAR, 3, '0') || ' | ' || n_name || ' |  |', chr(10) ORDER BY n_nationkey) AS md FROM nation GROUP BY n_regionkey",
        "reference_numbers": """
            WITH n AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)
            SELECT o_custkey, string_agg('- <a id="ref-' || i || '"></a>[' || i || '] ' || o_orderpriority, chr(10) ORDER BY i) AS md FROM n GROUP BY o_custkey""",
        "size_labels": """
            WITH c AS (SELECT doc_id, n_chars * 37 AS n FROM documents)
            SELECT doc_id, CASE WHEN n >= 1000000 THEN ((n + 50000) // 100000 // 10) || '.' || ((n + 50000) // 100000 % 10) || 'M' WHEN n >= 1000 THEN ((n + 50) // 100 // 10) || '.' || ((n + 50) // 100 % 10) || 'k' ELSE n || '' END AS label FROM c""",
        "author_heuristics": rf"""
            WITH u AS (SELECT author_id, unnest(list_concat([author_name], coalesce(affiliations, []))) AS t FROM paper_authors),
            v AS (SELECT *, regexp_replace(t, '^{_WS}|{_WS}$', '', 'g') AS s, regexp_replace(regexp_replace(t, '[\*†‡§¶‖#♯\d]+$', ''), '^{_WS}|{_WS}$', '', 'g') AS c FROM u WHERE t IS NOT NULL)
            SELECT author_id, t, c <> '' AND len(string_split(regexp_replace(c, '{_WS}', ' ', 'g'), ' ')) <= 6 AND NOT regexp_matches(c, '{_WORDS}') AND NOT contains(c, ',') AND NOT (upper(c) = c AND lower(c) <> c AND length(c) > 3) AND NOT contains(c, '@') AS is_name,
            length(s) >= 2 AND (regexp_matches(s, '{_WORDS}') OR regexp_matches(s, '\b[A-Z][a-z]+,\s*[A-Z][a-zA-Z\s]+\b')
              OR (len(string_split(regexp_replace(s, '{_WS}', ' ', 'g'), ' ')) <= 4 AND (regexp_matches(s, '[\d()\[\]]') OR (len(string_split(regexp_replace(s, '{_WS}', ' ', 'g'), ' ')) = 1 AND regexp_matches(s, '^\p{{Lu}}'))))) AS is_affiliation FROM v""",
        "listing_payloads": "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL",
        "batch_report": "SELECT CASE WHEN paper_id % 5 = 0 OR paper_id % 7 = 0 THEN 'skip' WHEN paper_id % 11 = 0 THEN 'error' ELSE 'ok' END AS status, count(*) AS n FROM papers GROUP BY ALL",
        "page_blocks": rf"""
            WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
            s AS (SELECT doc_id, n, trim(regexp_replace(line, '{_WS}', ' ', 'g')) AS t FROM l)
            SELECT doc_id, count(*) AS n, sha256(string_agg(t, chr(10) ORDER BY n)) AS sha256 FROM s WHERE t <> '' GROUP BY doc_id""",
        "page_sections": f"SELECT doc_id, 'Document ' || doc_id AS title, 1 AS n_sections, trim(regexp_replace(coalesce(section_title, 'Text'), '{_WS}', ' ', 'g')) AS first_title FROM documents WHERE text IS NOT NULL",
        "page_nodes": rf"""
            WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
            SELECT doc_id, 'paragraph' AS type, count(*) AS n FROM l WHERE trim(regexp_replace(line, '{_WS}', ' ', 'g')) <> '' GROUP BY doc_id
            UNION ALL SELECT doc_id, unnest(['document', 'section']), 1 FROM documents WHERE text IS NOT NULL""",
        "section_headings": r"SELECT section_id, len(regexp_extract_all(html, '<h[1-6][\s>]'))::INT AS n, nullif(regexp_extract(html, '<h([1-6])[\s>]', 1), '')::INT AS level FROM sections WHERE html IS NOT NULL",
        "page_images": "SELECT p_partkey AS doc_id, p_name || '.png' AS src FROM part",
        "tex_images": "SELECT p_partkey AS doc_id, 0::BIGINT AS ord, 'fig/' || p_brand AS ref FROM part UNION ALL SELECT p_partkey, 1, p_type FROM part",
    }
    return q | markup_queries.sql() | source_queries.sql()
