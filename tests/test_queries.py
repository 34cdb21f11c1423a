"""Every core query against its SQL on the smallest tables; nested records and streaming."""

import glob
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quirework.operators import nested
from quirework.plans import queries as Q
from quirework.streaming import inbox

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, duck, name):
    df = Q.queries()[name](spark, DATA)
    rows = df.collect()
    sql = Q.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    r = duck.sql(sql)
    assert sorted(r.columns) == sorted(df.columns)
    cols = sorted(df.columns)
    at = [r.columns.index(c) for c in cols]
    assert sorted((tuple(str(x[c]) for c in cols) for x in rows)) == sorted(tuple(str(x[k]) for k in at) for x in r.fetchall())


def test_nested_shapes(spark):
    doc = '{"sections": [{"struct_id": "a", "children": {"struct_id": "b", "blocks": [{"id": "b1"}]}}, 3, {"title": "c"}], "blocks": [{"id": "t1", "section_id": "b"}, {"id": "t2", "section_id": "zz"}, {"id": "t3"}]}'
    rows = [(1, doc), (2, '"' + doc.replace("\\", "\\\\").replace('"', '\\"') + '"'), (3, doc[:60]), (4, None), (5, ""), (6, "[]"), (7, '{"sections": null}')]
    df = spark.createDataFrame(rows, "record_id long, document_json string").withColumn("key", F.lit("clash")).withColumn("node_path", F.lit(1))
    sections, blocks = nested.flatten_documents(df)
    assert {(r.record_id, r.node_path, r.parent_path) for r in sections.collect()} == {(i, p, q) for i in (1, 2) for p, q in (("0", ""), ("0.0", "0"), ("2", ""))}
    assert {(r.block_id, r.parent_path) for r in blocks.filter("record_id = 1").collect()} == {("b1", "0.0"), ("t1", "0.0"), ("t2", None), ("t3", None)}
    empty = nested.flatten_documents(df.limit(0))
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_nested_beyond_the_plan(spark):
    doc = {"struct_id": "deep", "blocks": [{"id": "b", "level": 2}]}
    for k in range(300):
        doc = {"struct_id": f"s{k}", "children": [doc]}
    rows = [(1, json.dumps({"sections": [doc], "blocks": [{"id": "t", "section_id": "deep"}]})), (2, '{"sections": [{"struct_id": "a", "level": 3, "title": {"x": [1]}, "struct_id": "z"}]} '), (3, '{"sections": [{"struct_id": NaN}]}'), (4, "{'sections': []}")]
    df = spark.createDataFrame(rows, "record_id long, document_json string")
    for part in (df, df.filter("record_id > 1")):
        sections, blocks = nested.flatten_documents(part)
        got = {r.record_id: (r.struct_id, r.title, r.level) for r in sections.filter("record_id > 1").collect()}
        assert got == {2: ("z", '{"x":[1]}', 3)}
    sections, blocks = nested.flatten_documents(df)
    path = ".".join(["0"] * 301)
    assert sections.filter("record_id = 1").count() == 301 and {(r.block_id, r.parent_path) for r in blocks.collect()} == {("b", path), ("t", path)}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("2101.00001\n# c\nbad\n")
    q = inbox.write(inbox.lines(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert {r.kind for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"arxiv", "skip", "unknown"}
