from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomgraph.operators import graph

E = "edge_type string, src string, dst string"
N = "id string, kind string, name string, file_path string"


def build(spark, links, extra=()):
    ids = {x for _, a, b in links for x in (a, b) if x and not x.startswith("task:")} | set(extra)
    return spark.createDataFrame([(i, "function", i, "f.rs") for i in ids], N), spark.createDataFrame(links, E)


def near(spark, links, root="a", depth=1, most=50, **kw):
    out, truncated = graph.neighbourhood(*build(spark, links, kw.pop("extra", ())), root, depth, most, **kw)
    return {r.id: r.depth for r in out.collect()}, truncated


def test_shapes(spark):
    c = lambda *p: [("calls", *x.split("-")) for x in p]
    assert near(spark, c("a-b", "a-c")) == ({"b": 1, "c": 1}, False)
    assert near(spark, c("a-b", "b-c", "c-d"), depth=3) == ({"b": 1, "c": 2, "d": 3}, False)
    assert near(spark, c("a-b", "b-c", "c-a"), depth=5) == ({"b": 1, "c": 1}, False)
    assert near(spark, c("a-a"), depth=2) == ({}, False)
    assert near(spark, c("b-c"), root="nowhere") == ({}, False)
    assert near(spark, c("a-b", "x-y"), depth=5) == ({"b": 1}, False)
    got, truncated = near(spark, c(*[f"a-s{i}" for i in range(10)]), most=3)
    assert len(got) == 3 and truncated
    assert near(spark, [("concerns", "task:1", "a"), ("concerns", "task:1", "b")], depth=3) == ({}, False)


def test_discovery_edge(spark):
    links = [("defines", "a", "b"), ("calls", "a", "b"), ("calls", "c", "a"), ("imports", "a", "c")]
    out, _ = graph.neighbourhood(*build(spark, links), "a", 1)
    assert {r.id: (r.edge_type, r.src, r.dst, r.found) for r in out.collect()} == {"b": ("calls", "a", "b", 1), "c": ("imports", "a", "c", 2)}


def test_reachable(spark):
    _, e = build(spark, [("calls", "a", "b"), ("calls", "b", "a"), ("calls", "b", "c"), ("imports", "c", "d"), ("calls", "x", "a"), ("calls", None, "a"), ("calls", " ", "b")])
    ids = lambda d, t=graph.EDGE_TYPES: {r.id for r in graph.reachable(e, "a", d, t).collect()}
    assert ids(0) == set() and ids(1) == {"b"} and ids(2) == {"a", "b", "c"} and ids(9) == {"a", "b", "c", "d"} and ids(3, ("calls",)) == {"a", "b", "c"}


def test_tasks(spark):
    s = spark.createDataFrame([("function:1", "f", "function", "x.rs")], "id string, name string, kind string, file_path string")
    e = spark.createDataFrame([("concerns", "task:a", "function:1"), ("concerns", "task:a", "gone"), ("concerns", "task:a", "function:1")], E)
    assert {tuple(r) for r in graph.task_links(s, e).collect()} == {("task:a", "function:1", "f", "function"), ("task:a", "gone", "", "")}
    tasks = spark.createDataFrame([("task:a",), ("task:b",)], "id string")
    assert {tuple(r) for r in graph.links_of_tasks(tasks, s, e).collect()} == {("task:a", 2), ("task:b", 0)}
    assert graph.link_exists(e, "concerns", "task:a", "gone").first().there and not graph.link_exists(e, "calls", "task:a", "gone").first().there


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["calls", "imports"]), st.sampled_from("abcdefgh"), st.sampled_from("abcdefgh")), min_size=1, max_size=14), st.integers(1, 4))
def test_against_plain_search(spark, links, depth):
    want, level = {"a": 0}, ["a"]
    for d in range(1, depth + 1):
        level = [y for x in level for y in {b for _, p, b in links if p == x} | {p for _, p, b in links if b == x} if y not in want and not want.update({y: d})]
    want.pop("a")
    assert near(spark, links, depth=depth, most=None)[0] == want
