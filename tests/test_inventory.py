"""The smaller operators, and the promises about all queries."""

import json

from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomgraph.functions import embed
from loomgraph.operators import changes, graph, listing
from loomgraph.sources import schema, sinks


def test_validation(spark):
    df = spark.createDataFrame([("a", 1, "calls"), ("", 0, "calls"), (None, None, "x")], "name string, n int, kind string")
    good, bad = schema.split(df, [schema.filled("name"), schema.at_least("n", 1), schema.one_of("kind", ("calls",))])
    assert [r.name for r in good.collect()] == ["a"] and sorted(map(len, (r.faults for r in bad.collect()))) == [2, 3]
    v = spark.createDataFrame([([1.0],), ([float("nan")],), (None,), ([None],)], "embedding array<float>")
    assert schema.fault_counts(v, [schema.finite("embedding")]).first().n == 2


def test_projection_and_counts(spark):
    df = spark.createDataFrame([("1", "t", "s", "x")], "id string, title string, status string, other string")
    assert listing.project(df, brief=True).columns == ["id", "title", "status"] and listing.project(df, ["other", "none"]).columns == ["other"] and listing.project(df).columns == df.columns
    cases = [("list_symbols", {"symbols": [1, 2]}, (2, 2)), ("map_code", {"root": {"a": 1}, "neighbors": [1]}, (2, 2)), ("unified_search", {"results": [1, 2, 3]}, (0, 3)), ("query_graph", {"rows": []}, (0, 0)), ("other", {}, (0, 0))]
    rows = spark.createDataFrame([(t, json.dumps(r)) for t, r, _ in cases], "tool string, response string")
    got = [tuple(r.c) for r in rows.select(listing.response_counts(F.col("tool"), F.col("response")).alias("c")).collect()]
    assert got == [want for _, _, want in cases]


def test_edge_deletes(spark):
    e = spark.createDataFrame([("defines", "f", "a"), ("calls", "f", "a"), ("concerns", "t", "a"), ("concerns", None, None)], "edge_type string, src string, dst string")
    assert changes.drop_edges_from(e, "defines", "f").count() == 3
    kept, gone = changes.drop_concerns_of(e, "a")
    assert kept.count() == 3 and gone.first().removed == 1
    ids = spark.createDataFrame([("a",), ("x:1",)], "id string")
    assert graph.tasks_of_ids(e.unionByName(spark.createDataFrame([("concerns", "t", "x:1")], e.schema)), ids).collect() == [("t", "x:1")]


def test_embedder(spark):
    rows = spark.createDataFrame([("1", "alpha beta", None), ("2", None, None), ("3", "", []), ("4", "kept", [1.0])], "id string, content string, embedding array<float>")
    got = {r.id: r.embedding for r in embed.backfill(rows).collect()}
    assert len(got["1"]) == embed.DIMENSIONS and abs(sum(v * v for v in got["1"]) - 1) < 1e-5 and got["2"] is None and not any(got["3"]) and got["4"] == [1.0]
    assert embed.embed_text("alpha beta") == [float(v) for v in got["1"]]


def test_documents(spark, tmp_path):
    rows = spark.createDataFrame([("b", None), ("a", "x")], "id string, title string")
    assert sinks.write_documents(rows, str(tmp_path)) == 2
    assert json.loads((tmp_path / "backlog-b.json").read_text()) == {"id": "b"}
    assert sinks.manifest("p", None, None, "main", rows)["backlogs"] == [{"id": "a", "path": "backlog-a.json"}, {"id": "b", "path": "backlog-b.json"}]
    sinks.write_summary({"b": 1, "a": 2}, str(tmp_path / "s/summary.json"))
    assert json.loads((tmp_path / "s/summary.json").read_text()) == {"a": 2, "b": 1}


def test_entry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and entry.catalog.FLAGSHIP in queries
    assert len(queries) > 90 and len(sql) > 80
