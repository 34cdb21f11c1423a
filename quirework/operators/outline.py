"""Section trees as adjacency lists: hierarchy, numbers, filters, splits, printed trees.

All of it is windows and equi-joins on the document's key, so one partitioning serves the whole chain. Sections are
(doc_id, pos, level, title, ...), `pos` being their order in the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

LEVELS = 6


def with_parents(sections: DataFrame, doc: str = "doc_id", pos: str = "pos", level: str = "level") -> DataFrame:
    """Adds parent_pos: the nearest section before with a smaller level.

    For each level the latest position before is known by a running maximum; the parent is the greatest of those of smaller
    levels. Null for a top section. Levels are clamped to 1..6.
    """
    before = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    lv = F.greatest(F.lit(1), F.least(F.lit(LEVELS), F.col(level)))
    d = sections.withColumn(level, lv)
    for k in range(1, LEVELS):
        d = d.withColumn(f"_l{k}", F.max(F.when(F.col(level) == k, F.col(pos))).over(before))
    best = F.greatest(*[F.when(F.col(level) > k, F.col(f"_l{k}")) for k in range(1, LEVELS)], F.lit(None).cast("long"))
    return d.withColumn("parent_pos", best).drop(*[f"_l{k}" for k in range(1, LEVELS)])


def with_paths(sections: DataFrame, doc: str = "doc_id", pos: str = "pos", parent: str = "parent_pos") -> DataFrame:
    """Adds path (positions from the root to the section) and ordinal (0-based among siblings).

    Parents are followed by self-joins on (document, position), at most as many as there are levels.
    """
    siblings = Window.partitionBy(doc, parent).orderBy(pos)
    d = sections.withColumn("ordinal", F.row_number().over(siblings) - 1)
    up = d.select(doc, F.col(pos).alias("_up"), F.col(parent).alias("_next"))
    d = d.withColumn("path", F.array(F.col(pos))).withColumn("_up", F.col(parent))
    for _ in range(LEVELS - 1):
        d = d.join(up, [doc, "_up"], "left").withColumn("path", F.when(F.col("_up").isNotNull(), F.concat(F.array("_up"), "path")).otherwise(F.col("path"))).withColumn("_up", F.col("_next")).drop("_next")
    return d.drop("_up")


def outlined(sections: Column) -> Column:
    """A document's array of sections with parent_pos, path, ordinal, struct_id and number, all made in the row.

    The fold keeps what it has made so far: a section's parent is the last one before with a smaller level. For documents
    that come as one row each this needs no shuffle, where with_parents, with_paths and section_numbers take tables.
    """
    kind = (
        "array<struct<pos:int,level:int,title:string,anchor:string,unnumbered:boolean,parent_pos:int,path:array<int>,ordinal:int,ords:array<int>,counted:boolean,nums:array<int>>>"
    )

    def add(acc: Column, s: Column) -> Column:
        level = F.greatest(F.lit(1), F.least(F.lit(LEVELS), s["level"]))
        above = F.filter(acc, lambda x: x["level"] < level)
        parent = F.when(F.size(above) > 0, F.try_element_at(above, F.lit(-1)))
        same = F.filter(acc, lambda x: x["parent_pos"].eqNullSafe(parent["pos"]))
        counted = ~F.coalesce(s["unnumbered"], F.lit(False)) & (level < 5)
        nth = (F.size(F.filter(same, lambda x: x["counted"])) + counted.cast("int")).cast("int")
        none = F.expr("cast(array() as array<int>)")
        row = F.struct(
            s["pos"].cast("int").alias("pos"), level.cast("int").alias("level"), s["title"].alias("title"), s["anchor"].alias("anchor"), s["unnumbered"].alias("unnumbered"), parent["pos"].alias("parent_pos"),
            F.concat(F.coalesce(parent["path"], none), F.array(s["pos"].cast("int"))).alias("path"), F.size(same).alias("ordinal"), F.concat(F.coalesce(parent["ords"], none), F.array(F.size(same))).alias("ords"),
            counted.alias("counted"), F.concat(F.coalesce(parent["nums"], none), F.array(nth)).alias("nums"),
        )
        return F.concat(acc, F.array(row)).cast(kind)

    text = lambda a: F.transform(a, lambda x: x.cast("string"))
    done = F.aggregate(sections, F.expr(f"cast(array() as {kind})"), add)
    return F.transform(done, lambda x: F.struct(
        x["pos"].alias("pos"), x["level"].alias("level"), x["title"].alias("title"), x["anchor"].alias("anchor"), x["unnumbered"].alias("unnumbered"), x["parent_pos"].alias("parent_pos"), x["path"].alias("path"), x["ordinal"].alias("ordinal"),
        F.concat(F.lit("sec_"), F.array_join(text(x["ords"]), "_")).alias("struct_id"), F.when(x["counted"], F.array_join(text(x["nums"]), ".")).alias("number"),
    ))


def with_struct_ids(sections: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Fills struct_id with `sec_i_j` by the ordinals from the root, where it is missing. Needs path and ordinal."""
    ids = sections.select(doc, F.explode("path").alias("_p"), F.col(pos).alias("_of"))
    names = ids.join(sections.select(doc, F.col(pos).alias("_p"), "ordinal"), [doc, "_p"]).groupBy(doc, "_of").agg(F.sort_array(F.collect_list(F.struct("_p", "ordinal")))["ordinal"].alias("_o"))
    made = F.concat(F.lit("sec_"), F.array_join(F.transform("_o", lambda x: x.cast("string")), "_"))
    return sections.join(names.withColumnRenamed("_of", pos), [doc, pos], "left").withColumn("struct_id", F.coalesce("struct_id", made)).drop("_o")


def section_numbers(sections: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Adds number (`2.1.3`): running counts of numbered siblings along the path.

    A section of level 5 or more, or one marked unnumbered, has none; its children go on from its siblings' count so far.
    Needs path, parent_pos, level, unnumbered.
    """
    so_far = Window.partitionBy(doc, "parent_pos").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = (~F.coalesce("unnumbered", F.lit(False))) & (F.col("level") < 5)
    d = sections.withColumn("_own", F.sum(counted.cast("int")).over(so_far)).withColumn("_has", counted)
    steps = d.select(doc, F.col(pos).alias("_of"), F.explode("path").alias("_p")).join(d.select(doc, F.col(pos).alias("_p"), F.col("_own").alias("_n")), [doc, "_p"])
    path = steps.groupBy(doc, F.col("_of").alias(pos)).agg(F.sort_array(F.collect_list(F.struct("_p", "_n")))["_n"].alias("_ns"))
    return d.join(path, [doc, pos]).withColumn("number", F.when(F.col("_has"), F.array_join(F.transform("_ns", lambda n: n.cast("string")), "."))).drop("_own", "_has", "_ns")


def _matching(sections: DataFrame, titles: list[str], by_id: bool) -> Column:
    """Whether a section's title, up to its number and case, is one of the given, or its struct_id."""
    asked = F.array(*[T.normalized_title(F.lit(t)) for t in titles]) if titles else F.expr("cast(array() as array<string>)")
    hit = F.array_contains(asked, T.normalized_title(F.coalesce("title", F.lit(""))))
    if by_id and titles:
        hit |= F.coalesce(F.col("struct_id").isin(titles), F.lit(False))
    return F.coalesce(hit, F.lit(False))


def filter_tree(sections: DataFrame, mode: str, titles: list[str], doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Sections kept in the summary's tree. include: a match with its whole subtree and all ancestors. exclude: without a match's subtree.

    No titles: include and exclude both keep all. Needs path.
    """
    if not titles:
        return sections
    hits = sections.filter(_matching(sections, titles, False)).select(doc, F.col(pos).alias("_h"), F.col("path").alias("_hp"))
    below = sections.select(doc, pos, F.explode("path").alias("_h")).join(hits.select(doc, "_h"), [doc, "_h"], "left_semi").select(doc, pos)
    if mode == "exclude":
        return sections.join(below.distinct(), [doc, pos], "left_anti")
    above = hits.select(doc, F.explode("_hp").alias(pos))
    return sections.join(below.unionByName(above).distinct(), [doc, pos], "left_semi")


def filter_content(sections: DataFrame, mode: str, titles: list[str], doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Sections whose content is kept. include: those that match with all their ancestors matching. exclude: as in the tree.

    Matches by title or struct_id. Needs path.
    """
    if not titles:
        return sections
    marked = sections.withColumn("_m", _matching(sections, titles, "struct_id" in sections.columns))
    off = marked.filter(~F.col("_m") if mode == "include" else F.col("_m")).select(doc, F.col(pos).alias("_h"))
    gone = sections.select(doc, pos, F.explode("path").alias("_h")).join(off, [doc, "_h"], "left_semi").select(doc, pos).distinct()
    return sections.join(gone, [doc, pos], "left_anti")


def keeps_abstract(mode: str, titles: list[str]) -> bool:
    named = "abstract" in [t.strip().lower() for t in titles]
    return not named if mode == "exclude" else not titles or named


def without_empty(sections: DataFrame, blocks: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Sections with a block in them or in a descendant. Needs path."""
    full = sections.join(blocks.select(doc, F.col("sec_pos").alias(pos)).distinct(), [doc, pos], "left_semi")
    return sections.join(full.select(doc, F.explode("path").alias(pos)).distinct(), [doc, pos], "left_semi")


#: Titles of a reference list.
REFERENCE_TITLES = ("references", "bibliography")


def split_parts(sections: DataFrame, titles: tuple[str, ...] = REFERENCE_TITLES, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Adds part (main, references, appendix) to every section, by its top-level section.

    The first top section with a reference title parts the document in before, it, and after; without one, the first whose
    title begins with `appendix` begins the appendix. Numbers before the title don't count, letters do. Needs path.
    """
    d = sections.withColumn("_top", F.element_at("path", 1))
    title = F.lower(F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"^[\d.]+\s+", "")))
    all_of = Window.partitionBy(doc)
    is_top = F.col("_top") == F.col(pos)
    d = d.withColumn("_ref", F.min(F.when(is_top & title.isin(*titles), F.col(pos))).over(all_of)).withColumn("_app", F.min(F.when(is_top & title.startswith("appendix"), F.col(pos))).over(all_of))
    part = (
        F.when(F.col("_ref").isNotNull(), F.when(F.col("_top") < F.col("_ref"), "main").when(F.col("_top") == F.col("_ref"), "references").otherwise("appendix"))
        .when(F.col("_app").isNotNull() & (F.col("_top") >= F.col("_app")), "appendix").otherwise("main")
    )
    return d.withColumn("part", part).drop("_top", "_ref", "_app")


def printed_tree(sections: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """(doc, tree): titles in order, four blanks a depth. Needs path."""
    line = F.concat(F.repeat(F.lit("    "), F.size("path") - 1), F.coalesce("title", F.lit("")))
    return sections.groupBy(doc).agg(F.array_join(F.sort_array(F.collect_list(F.struct(F.col(pos), line.alias("l"))))["l"], "\n").alias("tree"))


def section_anchor(title: Column, struct_id: Column) -> Column:
    return F.coalesce(F.nullif(struct_id, F.lit("")), T.slug(title))


def rows_union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
