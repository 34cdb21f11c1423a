"""Set-based structure operators against sequential restatements of their meaning, on seeded random documents."""

import random

from pyspark.sql import functions as F

from quirework.operators import graph as G
from quirework.operators import numbering as N
from quirework.operators import outline as O


def docs(n=40, seed=3):
    r = random.Random(seed)
    return [(d, p, r.randint(1, 6), f"t{r.randint(0, 4)}", r.random() < 0.2) for d in range(n) for p in range(r.randint(1, 14))]


def stack_tree(rows):
    """doc -> pos -> (parent, path, ordinal, number)."""
    out = {}
    for d in {r[0] for r in rows}:
        seen, kids, nums, res = [], {}, {}, {}
        for _, p, lv, _, un in sorted(r for r in rows if r[0] == d):
            parent = next((q for q, l2 in reversed(seen) if l2 < lv), None)
            seen.append((p, lv))
            counted = not un and lv < 5
            k = nums.get(parent, 0) + counted
            nums[parent] = k
            base = res[parent][4] if parent is not None else []
            ordinal = kids.get(parent, 0)
            kids[parent] = ordinal + 1
            res[p] = (parent, (res[parent][1] if parent is not None else []) + [p], ordinal, ".".join(map(str, base + [k])) if counted else None, base + [k])
        out[d] = res
    return out


def test_tree_by_tables_and_in_the_row(spark):
    rows = docs()
    want = stack_tree(rows)
    df = spark.createDataFrame(rows, "doc_id int, pos int, level int, title string, unnumbered boolean").withColumn("struct_id", F.lit(None).cast("string"))
    t = O.section_numbers(O.with_struct_ids(O.with_paths(O.with_parents(df))))
    assert {(r.doc_id, r.pos): (r.parent_pos, r.path, r.ordinal, r.number) for r in t.collect()} == {(d, p): v[:4] for d, x in want.items() for p, v in x.items()}
    arrays = df.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "level", "title", F.lit(None).cast("string").alias("anchor"), "unnumbered"))).alias("s"))
    inrow = arrays.select("doc_id", F.inline(O.outlined(F.col("s"))))
    assert {(r.doc_id, r.pos): (r.parent_pos, r.path, r.ordinal, r.number) for r in inrow.collect()} == {(d, p): v[:4] for d, x in want.items() for p, v in x.items()}
    assert {(r.doc_id, r.pos): r.struct_id for r in t.collect()} == {(r.doc_id, r.pos): r.struct_id for r in inrow.collect()}


def test_filters(spark):
    rows = docs(30, 9)
    want = stack_tree(rows)
    title = {(r[0], r[1]): r[3] for r in rows}
    df = O.with_paths(O.with_parents(spark.createDataFrame(rows, "doc_id int, pos int, level int, title string, unnumbered boolean")))
    hit = lambda d, p: title[d, p] in ("t1", "t2")
    got = lambda x: {(r.doc_id, r.pos) for r in x.collect()}
    paths = {(d, p): v[1] for d, x in want.items() for p, v in x.items()}
    assert got(O.filter_tree(df, "exclude", ["1. T1", "t2"])) == {k for k, w in paths.items() if not any(hit(k[0], q) for q in w)}
    inside = {k for k, w in paths.items() if any(hit(k[0], q) for q in w)}
    above = {(d, q) for (d, p), w in paths.items() if hit(d, p) for q in w}
    assert got(O.filter_tree(df, "include", ["t1", "t2"])) == inside | above
    assert got(O.filter_content(df, "include", ["t1", "t2"])) == {k for k, w in paths.items() if all(hit(k[0], q) for q in w)}
    assert got(O.filter_tree(df, "include", [])) == set(paths)
    assert O.keeps_abstract("exclude", ["Abstract"]) is False and O.keeps_abstract("include", ["x"]) is False and O.keeps_abstract("include", [])


def test_split_parts(spark):
    rows = [(1, 0, 1, "Intro"), (1, 1, 1, "7 References"), (1, 2, 1, "More"), (2, 0, 1, "A"), (2, 1, 1, "Appendix B"), (2, 2, 2, "Sub"), (3, 0, 1, None)]
    df = O.with_paths(O.with_parents(spark.createDataFrame(rows, "doc_id int, pos int, level int, title string")))
    assert [r.part for r in O.split_parts(df).orderBy("doc_id", "pos").collect()] == ["main", "references", "appendix", "main", "appendix", "appendix", "main"]


def test_numbers_take_the_missing_integers(spark):
    r = random.Random(5)
    rows = [(d, p, r.choice(["figure", "table"]), r.choice([None, None, 1, 2, 3, 7])) for d in range(40) for p in range(r.randint(1, 12))]
    want = {}
    for d in range(40):
        for kind in ("figure", "table"):
            mine = [x for x in rows if x[0] == d and x[2] == kind]
            claimed, n = {x[3] for x in mine if x[3]}, 0
            for _, p, _, c in sorted(mine):
                if c is None:
                    n += 1
                    while n in claimed:
                        n += 1
                want[d, p] = c if c is not None else n
    got = N.number_blocks(spark.createDataFrame(rows, "doc_id int, pos int, kind string, claimed int"))
    assert {(x.doc_id, x.pos): x.number for x in got.collect()} == want


def test_figures_follow_their_first_citation(spark):
    r = random.Random(8)
    rows = []
    for d in range(40):
        for p in range(r.randint(2, 9)):
            fig = r.random() < 0.4
            rows.append((d, 0, p, "figure" if fig else "paragraph", None if fig else f"see Fig. {r.randint(1, 4)}", r.randint(1, 4) if fig else None))
    want = {}
    for d in range(40):
        mine = sorted(x for x in rows if x[0] == d)
        order = [x for x in mine]
        for x in [y for y in mine if y[3] == "figure"]:
            at = next((k for k, y in enumerate(mine) if y[3] == "paragraph" and y[4] == f"see Fig. {x[5]}"), None)
            if at is not None and mine[at][2] < x[2]:
                order.remove(x)
                order.insert(order.index(mine[at]) + 1, x)
        want |= {(d, x[2]): k + 1 for k, x in enumerate(order)}
    got = N.reorder_figures(spark.createDataFrame(rows, "doc_id int, scope int, pos int, kind string, text string, number int"))
    assert {(x.doc_id, x.pos): x.new_pos for x in got.collect()} == want


def test_anchors_and_links(spark):
    b = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, "a"), (1, 3, "a-2"), (1, 4, None)], "doc_id int, pos int, base string")
    got = [x.anchor for x in N.unique_anchors(b).orderBy("pos").collect()]
    assert got == ["a", "a-2", "a-3", "a-2-2", None]
    clash = spark.createDataFrame([(1, k, b) for k, b in enumerate(["a", "a", "a-2", "a-2-2", "a-2"])] + [(2, 0, None)], "doc_id int, pos int, base string")
    assert [x.anchor for x in N.unique_anchors(clash).orderBy("doc_id", "pos").collect()] == ["a", "a-2", "a-2-2", "a-2-2-2", "a-2-3", None]
    blocks = spark.createDataFrame([(1, 0, "l", "x"), (1, 5, "l", "y")], "doc_id int, pos int, label string, anchor string")
    links = spark.createDataFrame([(1, 1, "l"), (1, 2, "m")], "doc_id int, n int, target_id string")
    assert [x.target for x in N.point_links(links, blocks).orderBy("n").collect()] == ["y", "m"]


def test_graph_and_assets(spark):
    docs_ = spark.createDataFrame([(1, "T")], "doc_id int, title string")
    secs = spark.createDataFrame([(1, 0, None, "s0", "A", 1), (1, 1, 0, "s1", "B", 2)], "doc_id int, pos int, parent_pos int, struct_id string, title string, level int")
    blocks = spark.createDataFrame([(1, "s0", 1, "paragraph", "x"), (1, "s0", 2, "code", "y")], "doc_id int, section string, index int, kind string, text string")
    assets = spark.createDataFrame([(1, "a.png", "image"), (1, "a.png", "image")], "doc_id int, path string, kind string")
    nodes, edges = G.graph(docs_, secs, blocks, assets)
    assert {(r.type, r.n) for r in G.node_counts(nodes).collect()} == {("paper", 1), ("section", 2), ("block", 2), ("asset", 1)}
    assert {(r.type, r.scope) for r in edges.collect()} == {("contains", None), ("child_section", None), ("next", "section"), ("next", "block")}
    a = spark.createDataFrame([(1, 0, "b.png", "image", "b"), (1, 1, "b.png", "image", "b"), (1, 2, "c.png", "image", "b")], "doc_id int, pos int, path string, kind string, stem string")
    r = G.asset_list(a).first()
    assert [x.path for x in r.assets] == ["b.png", "c.png"] and r.stems == {"b": "c.png"}


def test_deeper_records_than_planned(spark, monkeypatch):
    import json

    from quirework.operators import nested

    def record(depth):
        node = {"struct_id": f"s{depth}", "level": 1.5, "blocks": [{"id": f"b{depth}"}]}
        for k in range(depth - 1, 0, -1):
            node = {"struct_id": f"s{k}", "children": [None, node] if k % 2 else node, "blocks": {"id": f"b{k}"}}
        return {"sections": [node], "blocks": [{"id": "top", "section_id": f"s{depth}"}, {"id": "none"}]}

    rows = [(1, json.dumps(record(3))), (2, json.dumps(json.dumps(record(90)))), (3, json.dumps(record(90))[:-5]), (4, None), (5, json.dumps(record(600)))]
    df = spark.createDataFrame(rows, "record_id long, document_json string")
    sections, blocks = nested.flatten_documents(df)
    got, inside = sections.collect(), blocks.collect()
    assert {k: sum(r.record_id == k for r in got) for k in range(1, 6)} == {1: 3, 2: 90, 3: 0, 4: 0, 5: 600}
    assert {k: sum(r.record_id == k for r in inside) for k in range(1, 6)} == {1: 5, 2: 92, 3: 0, 4: 0, 5: 602}
    path = {(r.record_id, r.struct_id): r.node_path for r in got}
    assert all(r.parent_path == path.get((r.record_id, f"s{int(r.struct_id[1:]) - 1}"), "") for r in got)
    assert all(r.parent_path == path[r.record_id, {1: "s3", 2: "s90", 5: "s600"}[r.record_id]] for r in inside if r.block_id == "top")
    # both ways agree
    small = df.filter("record_id = 1")
    want = [sorted(map(str, d.collect())) for d in nested.flatten_documents(small)]
    monkeypatch.setattr(nested, "MAX_DEPTH", 1)
    assert [sorted(map(str, d.collect())) for d in nested.flatten_documents(small)] == want


def test_anchors_are_joined_without_a_broadcast(spark):
    b = spark.range(20).selectExpr("id % 3 doc_id", "id pos", "'a' base")
    plan = N.unique_anchors(b)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
