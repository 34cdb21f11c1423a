"""The flagship plan: pages or TeX to sections, blocks, Markdown, JSON and graph, for a whole corpus at once."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.session import cut_lineage
from ..operators import graph as G
from ..operators import images as I
from ..operators import markdown as M
from ..operators import numbering as N
from ..operators import outline as O
from ..operators import pages as P


@dataclass(frozen=True)
class Options:
    """Options of a run; `sections` are titles or struct ids, `mode` include or exclude."""

    mode: str = "exclude"
    sections: tuple[str, ...] = ()
    anchors: bool = False
    number_sections: bool = False
    reference_titles: tuple[str, ...] = O.REFERENCE_TITLES


@dataclass(frozen=True)
class Tables:
    """Parsed documents as tables; every pass takes such a bundle and gives another."""

    docs: DataFrame
    sections: DataFrame
    blocks: DataFrame
    options: Options = field(default_factory=Options)
    svgs: DataFrame | None = None

    def transform(self, *passes) -> Tables:
        out = self
        for p in passes:
            out = p(out)
        return out


def from_parsed(parsed: DataFrame, options: Options = Options()) -> Tables:
    """Parsed rows, stored once since many passes read them, as tables."""
    parsed = cut_lineage(parsed)
    has = "unnumbered" in parsed.schema["sections"].dataType.elementType.names
    items = F.transform("sections", lambda s: F.struct(s["pos"].alias("pos"), s["level"].alias("level"), s["title"].alias("title"), s["anchor"].alias("anchor"), (s["unnumbered"] if has else F.lit(False)).alias("unnumbered")))
    sections = parsed.select("doc_id", F.inline(O.outlined(items)))
    blocks = P.blocks_of(parsed).withColumn("order", F.col("pos"))
    return Tables(parsed.select("doc_id", "title", "authors", "abstract", T.parsed_date(F.col("submission_date")).alias("submission_date")), sections, blocks, options, parsed.select("doc_id", F.inline("svgs")))


def section_filter(t: Tables) -> Tables:
    o = t.options
    kept = O.filter_content(t.sections, o.mode, list(o.sections))
    blocks = t.blocks.join(kept.select("doc_id", F.col("pos").alias("sec_pos")), ["doc_id", "sec_pos"], "left_semi")
    # the title block isn't a section, and the abstract counts as one only by its name
    kept_regions = ["front_matter", *(["abstract"] if O.keeps_abstract(o.mode, list(o.sections)) else [])]
    blocks = blocks.unionByName(t.blocks.filter(F.col("region").isin(kept_regions)))
    return replace(t, sections=kept, blocks=blocks)


def empty_sections(t: Tables) -> Tables:
    return replace(t, sections=O.without_empty(t.sections, t.blocks))


def numbers(t: Tables) -> Tables:
    """Blocks of the abstract and the sections; those of the title block keep the number of their own caption."""
    beside = F.col("region") == "front_matter"
    numbered = N.number_blocks(t.blocks.filter(~beside).withColumnRenamed("number", "claimed"))
    return replace(t, blocks=numbered.unionByName(t.blocks.filter(beside).withColumn("claimed", F.col("number"))))


def section_titles(t: Tables) -> Tables:
    if not t.options.number_sections:
        return t
    s = t.sections.withColumn("title", F.concat_ws(" ", "number", "title")).withColumn("struct_id", F.coalesce("number", "struct_id"))
    return replace(t, sections=s)


def figure_order(t: Tables) -> Tables:
    b = t.blocks.withColumn("scope", F.coalesce("sec_pos", F.lit(-1)))
    figures = F.when(F.col("kind") == "figure", F.col("number"))
    moved = N.reorder_figures(b.withColumn("_fig", figures), number="_fig")
    return replace(t, blocks=moved.withColumn("order", F.col("new_pos")).drop("scope", "_fig", "new_pos"))


def anchors(t: Tables) -> Tables:
    made = F.when(F.col("kind").isin(*N.KINDS), N.block_id(F.col("kind"), F.col("number")))
    based = t.blocks.withColumn("base", F.coalesce(made, N.block_anchor(F.col("kind"), F.lit(None).cast("string"), F.col("label"), F.col("number"))))
    s = t.sections.withColumn("anchor", O.section_anchor(F.col("title"), F.col("struct_id")))
    return replace(t, sections=s, blocks=N.unique_anchors(based).drop("base"))


def parts(t: Tables) -> Tables:
    return replace(t, sections=O.split_parts(t.sections, t.options.reference_titles))


DEFAULT = (section_filter, empty_sections, numbers, section_titles, figure_order, anchors, parts)


def convert(pages: DataFrame, key: str = "doc_id", html: str = "html", options: Options = Options()) -> Tables:
    """Pages through the default passes."""
    return from_parsed(P.parse_pages(pages, key, html), options).transform(*DEFAULT)


def _written(t: Tables) -> DataFrame:
    """Blocks with md."""
    return t.blocks if "md" in t.blocks.columns else M.block_markdown(t.blocks, t.options.anchors, linked_citations=t.options.anchors)


def stored(t: Tables) -> Tables:
    """The same tables, with each block's Markdown, stored for several outputs to read."""
    keep = ["doc_id", "region", "sec_pos", "pos", "order", "kind", "indent", "list_no", "text", "md", "images"]
    return replace(t, sections=cut_lineage(t.sections), blocks=cut_lineage(_written(t).select(*keep)))


def to_markdown(t: Tables) -> DataFrame:
    """(doc_id, content, content_references, content_appendix)."""
    md = M.document_markdown(t.sections, _written(t), t.options.anchors)
    part = lambda p: F.max(F.when(F.col("part") == p, F.col("markdown")))
    return md.groupBy("doc_id").agg(part("main").alias("content"), part("references").alias("content_references"), part("appendix").alias("content_appendix"))


def summary(t: Tables, counted: DataFrame | None = None) -> DataFrame:
    """(doc_id, summary, sections_tree); `counted` may give (doc_id, tokens)."""
    n = t.sections.groupBy("doc_id").agg(F.count("*").alias("n_sections"))
    d = t.docs.join(n, "doc_id", "left").join(O.printed_tree(t.sections), "doc_id", "left")
    if counted is not None:
        d = d.join(counted, "doc_id", "left")
    tokens = T.human_count(F.col("tokens")) if counted is not None else F.lit(None).cast("string")
    line = lambda name, v: F.concat(F.lit(name + ": "), v)
    names = F.array_join(F.transform("authors", lambda a: F.when(F.size(a["affiliations"]) > 0, F.concat(a["name"], F.lit(" ("), F.array_join(a["affiliations"], "; "), F.lit(")"))).otherwise(a["name"])), ", ")
    text = F.concat_ws("\n", line("Title", F.col("title")), line("Authors", F.nullif(names, F.lit(""))), line("Sections", F.coalesce("n_sections", F.lit(0)).cast("string")), line("Estimated tokens", tokens))
    return d.select("doc_id", text.alias("summary"), F.col("tree").alias("sections_tree"))


def to_json(t: Tables, mode: str = "document") -> DataFrame:
    """(doc_id, json): `meta` alone, `document` with sections and blocks, `full` with Markdown of each block too; `none` gives no rows."""
    mode = mode if mode in ("meta", "document", "full", "all") else "none"
    if mode == "none":
        return t.docs.limit(0).select("doc_id", F.lit("").alias("json"))
    meta = F.struct(F.lit("2.0").alias("schema_version"), "title", F.col("authors.name").alias("authors"), "submission_date", "abstract")
    if mode == "meta":
        return t.docs.select("doc_id", F.to_json(meta, {"ignoreNullFields": "false"}).alias("json"))
    b = _written(t)
    ident = G.block_ids(F.coalesce("struct_id", "region"), F.col("order"), F.col("kind"))
    cols = [ident.alias("id"), F.col("kind").alias("type"), F.col("struct_id").alias("section_id"), F.col("order").alias("order_index"), F.col("text").alias("text_plain")]
    cols += [F.col("md").alias("text_md")] if mode != "document" else []
    placed = b.join(t.sections.select("doc_id", F.col("pos").alias("sec_pos"), "struct_id"), ["doc_id", "sec_pos"], "left")
    blocks = placed.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("sec_pos", F.lit(-1)).alias("s"), F.col("order").alias("o"), F.struct(*cols).alias("b"))))["b"].alias("blocks"))
    secs = t.sections.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct("struct_id", "title", "level", "anchor").alias("x"))))["x"].alias("sections"))
    d = t.docs.join(secs, "doc_id", "left").join(blocks, "doc_id", "left")
    return d.select("doc_id", F.to_json(F.struct(meta.alias("meta"), "sections", "blocks"), {"ignoreNullFields": "false"}).alias("json"))


def to_assets(t: Tables) -> DataFrame:
    """(doc_id, pos, path, kind, stem, content): distinct images of the documents in order, with the markup of those drawn in the page."""
    refs = t.blocks.select("doc_id", F.col("pos").alias("ord"), F.explode("images").alias("i")).select("doc_id", "ord", F.col("i.src").alias("src"))
    return I.assets(refs, t.svgs)


def to_graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    placed = t.blocks.join(t.sections.select("doc_id", F.col("pos").alias("sec_pos"), F.col("struct_id").alias("section")), ["doc_id", "sec_pos"])
    images = t.blocks.select("doc_id", "pos", F.explode("images").alias("i")).select("doc_id", "pos", F.col("i.src").alias("path"), F.lit("image").alias("kind"))
    return G.graph(t.docs, t.sections, placed.withColumn("index", F.col("order")), images)


def content_fingerprint(t: Tables) -> DataFrame:
    """(doc_id, sha256) over the abstract's and each section's Markdown in order; what stands in the title block doesn't count."""
    b = M.tight(_written(t).filter("region != 'front_matter'"))
    parts_of = b.groupBy("doc_id", F.coalesce("sec_pos", F.lit(-1)).alias("s")).agg(M.joined_blocks(F.sort_array(F.collect_list(F.struct("order", "md")))["md"]).alias("md"))
    return parts_of.groupBy("doc_id").agg(T.fingerprint(F.sort_array(F.collect_list(F.struct("s", "md")))["md"]).alias("sha256"))
