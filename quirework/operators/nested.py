"""Deeply nested JSON records as flat child tables with parent links (problem 6).

A merged schema is inferred over all records first: for each structural path the JSON kinds it takes anywhere and how
often. It tells how deep a self-nesting array goes, and so what type a record has: nested structs, read by one
`from_json` that decodes the fields asked for and skips the rest. Each array level is then opened with array functions in
the row that holds it (child key = parent key + ordinal), and a block's parent is looked up there too, so the whole
flattening is one narrow stage: no shuffle, no Python in the hot path, and a record's nodes never leave its task.
Records that don't fit the type (an object where a list is expected, JSON inside a JSON string, more levels than are
planned) are opened one by one, with a queue.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: The most levels Spark is asked to plan, whose time grows with them (its analyzer gives up at 64).
MAX_DEPTH = 8
#: Fields of a section and of a block, and the lists of blocks that a record may have at its top.
SECTION = ("struct_id", "title", "level", "anchor", "html_sha256")
BLOCK = ("id", "section_id", "type", "order_index", "text_plain", "text_md", "extra")
TOP_LISTS = ("abstract_blocks", "front_matter_blocks", "blocks", "bibliography_blocks")
#: Paths of lists and of their elements.
_LISTS = rf"^(?:sections|{'|'.join(TOP_LISTS)}|sections\[\](?:\.children\[\])*\.(?:children|blocks))"
_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": "_bad"}


def infer_paths(df: DataFrame, json_col: str) -> DataFrame:
    """Merged schema of all complete records: (path, kind, n), with `[]` for an array's elements.

    Each partition folds its own records before the shuffle, which then carries only distinct paths.
    Null, blank and cut-off texts count as kind `incomplete` at the root path ''.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for text in pdf["t"]:
                try:
                    value = json.loads(text)
                    if isinstance(value, str):
                        value = json.loads(value)
                except (TypeError, ValueError):
                    seen["", "incomplete"] += 1
                    continue
                stack = [("", value)]
                while stack:
                    path, v = stack.pop()
                    if isinstance(v, dict):
                        seen[path, "object"] += 1
                        stack += [(f"{path}.{k}" if path else k, x) for k, x in v.items()]
                    elif isinstance(v, list):
                        seen[path, "array"] += 1
                        stack += [(f"{path}[]", x) for x in v]
                    else:
                        kind = "null" if v is None else type(v).__name__
                        seen[path, kind] += 1
        rows = [(p, k, n) for (p, k), n in seen.items()]
        yield pd.DataFrame(rows, columns=["path", "kind", "n"])

    parts = df.select(F.col(json_col).alias("t")).mapInPandas(fold, "path string, kind string, n long")
    return parts.groupBy("path", "kind").agg(F.sum("n").alias("n"))


def shape(df: DataFrame, json_col: str) -> tuple[int, bool]:
    """(levels of sections, whether any record has something else where a list or an element of one is expected).

    The depth is 1 for `sections` alone and one more for each `children` below. Both come from the merged schema; one row comes to the driver.
    """
    paths = infer_paths(df, json_col)
    steps = F.when(F.col("path").startswith("sections") & (F.col("kind") == "object"), F.regexp_count("path", F.lit(r"\.children(?=$|\.|\[)")))
    odd = F.col("path").rlike(_LISTS + "$") & ~F.col("kind").isin("array", "null") | F.col("path").rlike(_LISTS + r"\[\]$") & ~F.col("kind").isin("object", "null")
    got = paths.agg(F.max(steps).alias("d"), F.max(odd).alias("odd")).first()
    return 1 + (got["d"] or 0), bool(got["odd"])


def _type(depth: int, section: tuple[str, ...], block: tuple[str, ...]) -> str:
    """Type of a record whose sections nest to `depth`."""
    texts = lambda names: ", ".join(f"{n} string" for n in names)
    blocks = f"array<struct<{texts(block)}>>"
    node = ""
    for _ in range(depth):
        inner = f", children array<{node}>" if node else ""
        node = f"struct<{texts(section)}, blocks {blocks}{inner}>"
    return f"sections array<{node}>, {', '.join(f'{t} {blocks}' for t in TOP_LISTS)}, _bad string"


def _arrays(section: tuple[str, ...], block: tuple[str, ...]) -> str:
    texts = lambda names: "".join(f", {n} string" for n in names)
    return f"nodes array<struct<node_path string, parent_path string, ordinal int{texts(section)}>>, blocks array<struct<parent_path string, list_name string, ordinal int{texts(block)}>>"


def _open(doc: DataFrame, depth: int, section: tuple[str, ...], block: tuple[str, ...]) -> DataFrame:
    """(key, nodes, blocks) of typed records: every level's nodes, and all blocks with the path of their section."""
    levels = []
    df = doc
    for k in range(depth):
        def node(v: Column, i: Column, up: Column | None) -> Column:
            path = i.cast("string") if up is None else F.concat(up["node_path"], F.lit("."), i.cast("string"))
            return F.struct(path.alias("node_path"), (F.lit("") if up is None else up["node_path"]).alias("parent_path"), i.alias("ordinal"), v.alias("v"))

        if k == 0:
            opened = F.transform(F.col("doc.sections"), lambda v, i: node(v, i, None))
        else:
            opened = F.flatten(F.transform(levels[-1], lambda n: F.coalesce(F.transform(n["v"]["children"], lambda v, i: node(v, i, n)), F.array())))
        # elements that aren't objects keep their ordinal, but are no nodes
        df = df.withColumn(f"l{k}", F.coalesce(F.filter(opened, lambda n: n["v"].isNotNull()), F.array()))
        levels.append(F.col(f"l{k}"))

    flat = lambda n: F.struct(n["node_path"].alias("node_path"), n["parent_path"].alias("parent_path"), n["ordinal"].alias("ordinal"), *[n["v"][f].alias(f) for f in section])
    placed = lambda items, name, parent: F.coalesce(
        F.transform(F.filter(F.transform(items, lambda b, i: F.struct(i.alias("ordinal"), b.alias("b"))), lambda x: x["b"].isNotNull()), lambda x: F.struct(parent(x["b"]).alias("parent_path"), F.lit(name).alias("list_name"), x["ordinal"].alias("ordinal"), *[x["b"][f].alias(f) for f in block])),
        F.array(),
    )
    df = df.withColumn("nodes", F.concat(*[F.transform(x, flat) for x in levels])).withColumn("ids", F.transform("nodes", lambda n: F.coalesce(n["struct_id"], F.lit(""))))
    # the first section that has a top block's section_id
    at = lambda b: F.nullif(F.array_position("ids", F.nullif(b["section_id"], F.lit(""))), F.lit(0))
    inside = [F.flatten(F.transform(x, lambda n: placed(n["v"]["blocks"], "blocks", lambda b: n["node_path"]))) for x in levels]
    top = [placed(F.col(f"doc.{t}"), t, lambda b: F.get("nodes", (at(b) - 1).cast("int"))["node_path"]) for t in TOP_LISTS]
    return df.select("key", "nodes", F.concat(*inside, *top).alias("blocks"))


def _reader(section: tuple[str, ...], block: tuple[str, ...], kind: str):
    schema = to_arrow_schema(_parse_datatype_string(f"key {kind}, {_arrays(section, block)}"))

    def constant(name: str) -> None:
        raise ValueError(name)

    def items(v: object) -> list:
        return v if isinstance(v, list) else [v] if isinstance(v, dict) else []

    def text(v: object) -> str | None:
        return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))

    def blocks_of(holder: dict, name: str, parent) -> list[dict]:
        return [{"parent_path": parent(b), "list_name": name, "ordinal": i} | {f: text(b.get(f)) for f in block} for i, b in enumerate(items(holder.get(name))) if isinstance(b, dict)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, trees, lists = [], [], []
            for key, t in zip(*[c.to_pylist() for c in batch.columns]):
                try:
                    doc = json.loads(t, parse_constant=constant)
                    if isinstance(doc, str):
                        doc = json.loads(doc, parse_constant=constant)
                except ValueError:
                    continue
                if not isinstance(doc, dict):
                    continue
                nodes, inside, first, level = [], [], {}, [("", items(doc.get("sections")))]
                while level:
                    below = []
                    for up, listed in level:
                        for i, v in enumerate(listed):
                            if isinstance(v, dict):
                                path = f"{up}.{i}" if up else str(i)
                                nodes.append({"node_path": path, "parent_path": up, "ordinal": i} | {f: text(v.get(f)) for f in section})
                                if name := text(v.get("struct_id")):
                                    first.setdefault(name, path)
                                inside += blocks_of(v, "blocks", lambda b: path)
                                below.append((path, items(v.get("children"))))
                    level = below
                top = [b for name in TOP_LISTS for b in blocks_of(doc, name, lambda b: first.get(text(b.get("section_id")) or None))]
                keys.append(key), trees.append(nodes), lists.append(inside + top)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((keys, trees, lists), schema)], schema=schema)

    return run


def open_documents(df: DataFrame, key: str, json_col: str, section: tuple[str, ...] = SECTION, block: tuple[str, ...] = BLOCK) -> DataFrame:
    """(key, nodes, blocks): one row for each complete record, with the fields asked for (struct_id, id and section_id always)."""
    section, block = tuple(dict.fromkeys(("struct_id", *section))), tuple(dict.fromkeys(("id", "section_id", *block)))
    depth, odd = shape(df, json_col)
    texts = df.select(F.col(key).alias("key"), F.col(json_col).alias("t")).filter("t is not null")
    planned = min(depth, MAX_DEPTH)
    usual = F.col("t").rlike(r"^\s*\{")
    if depth > MAX_DEPTH:
        # a name for each level at least, if it isn't written with escapes
        usual &= (F.regexp_count("t", F.lit("children")) < MAX_DEPTH) & ~F.col("t").contains("\\u00")
    typed = texts.filter(usual).select("key", "t", F.from_json("t", _type(planned, section, block), _JSON).alias("doc"))
    out = _open(typed.filter("doc is not null and doc._bad is null").select("key", "doc"), planned, section, block)
    # records that the type doesn't fit are read twice; the merged schema tells whether there may be any
    rest = texts.filter(~usual)
    if odd:
        rest = rest.unionByName(typed.filter("doc is null or doc._bad is not null").select("key", "t"))
    kind = texts.schema["key"].dataType.simpleString()
    return out.unionByName(rest.mapInArrow(_reader(section, block, kind), f"key {kind}, {_arrays(section, block)}"))


def flatten_documents(df: DataFrame, key: str = "record_id", json_col: str = "document_json") -> tuple[DataFrame, DataFrame]:
    """(sections, blocks) of exported documents of either shape, each row with its parent.

    sections: key, node_path, parent_path, ordinal, struct_id, title, level, anchor, html_sha256.
    blocks: key, block_id, parent_path, list_name, ordinal, section_id, type, order_index, text_plain, text_md, extra (JSON text).
    parent_path of a block is the section it lies in, or for one listed at the top the first section with its
    section_id, or null where there is none. A record that is null, blank or cut off gives no row; an object where
    a list is expected counts as a list of one; elements that aren't objects are passed over but keep their ordinal; an
    object or list where a text is expected gives its JSON text. Of a name that an object has twice the last counts.
    Sections may nest to any depth that a JSON reader can follow; a text beyond that is an error. An empty table gives two
    empty tables. Other columns of `df`, whatever their names, aren't read.
    """
    opened = open_documents(df, key, json_col)
    number = lambda c: F.expr(f"try_cast({c} as int)").alias(c)
    sections = opened.select(F.col("key").alias("_key"), F.inline("nodes")).select(F.col("_key").alias(key), "node_path", "parent_path", "ordinal", "struct_id", "title", number("level"), "anchor", "html_sha256")
    blocks = opened.select(F.col("key").alias("_key"), F.inline("blocks")).select(
        F.col("_key").alias(key), F.col("id").alias("block_id"), "parent_path", "list_name", "ordinal", "section_id", "type", number("order_index"), "text_plain", "text_md", "extra")
    return sections, blocks


def found(spark, sf_dir: str) -> DataFrame:
    """p6_found: sections and the blocks that belong to one, each with its parent."""
    opened = open_documents(spark.read.parquet(f"{sf_dir}/paper_documents.parquet"), "record_id", "document_json", (), ())
    row = lambda x, path: F.struct(x[path].alias("node_path"), x["parent_path"].alias("parent_path"))
    rows = F.concat(F.transform("nodes", lambda n: row(n, "node_path")), F.transform(F.filter("blocks", lambda b: b["parent_path"].isNotNull()), lambda b: row(b, "id")))
    return opened.select(F.col("key").alias("record_id"), F.inline(rows))
