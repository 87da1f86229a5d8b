"""Orphan references and hierarchies: defined results for nulls, ties, repeats, empty tables, clashing columns."""

from datetime import datetime

import numpy as np
import pyarrow as pa
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomgraph.operators import hierarchy, orphans

E = "edge_id long, src string, dst string, created_at timestamp_ntz, cell string, ref_id string"
P = "id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, lane string"


def t(d):
    return d and datetime(2025, 1, d)


def found(spark, edges, parents, **kw):
    e = spark.createDataFrame([(i, s, d, t(at), "clash", "clash") for i, s, d, at in edges], E)
    p = spark.createDataFrame([(i, t(a), t(b), "clash") for i, a, b in parents], P)
    return sorted(tuple(r) for r in orphans.orphans(e, [p, p.limit(0)], **kw).collect())


def test_states(spark):
    parents = [("f:1", 5, None), ("f:2", 5, 10), ("f:2", 12, 14), ("f:3", None, None)]
    edges = [
        (1, "f:1", "f:1", 5), (2, "f:1", "f:1", 4), (3, "f:2", "f:2", 9), (4, "f:2", "f:2", 10), (5, "f:2", "x", 13), (6, "nocolon", " ", 13),
        (7, None, "", 1), (8, "f:9", "f:3", None), (9, "f:3", "f:3", 20), (3, "f:2", "f:2", 9), (10, "a:b:c", None, 14),
    ]
    want = [
        (2, "dst", "f", "2025-01", "late"), (2, "src", "f", "2025-01", "late"), (4, "dst", "f", "2025-01", "deleted"), (4, "src", "f", "2025-01", "deleted"),
        (5, "dst", "unknown", "2025-01", "missing"), (6, "src", "unknown", "2025-01", "missing"), (8, "src", "f", "none", "missing"),
        (9, "dst", "f", "2025-01", "late"), (9, "src", "f", "2025-01", "late"), (10, "src", "a", "2025-01", "missing"),
    ]
    assert found(spark, edges, parents) == want
    assert found(spark, edges, parents, lane_rows=2) == want  # hot ranges cut into lanes


def test_keys_of_one_hash():
    """Ids that share a hash are told apart by themselves."""
    keys = orphans.Keys(np.array([1, 1, 1, 5, 5, 9]), pa.array(["a", "b", "b", "c", "d", "e"]))
    assert keys.number.tolist() == [0, 1, 1, 2, 3, 4]
    at, there = keys.find(np.array([1, 1, 1, 5, 9, 9, 7, 99]), pa.array(["b", "a", "x", "d", "e", "f", "g", "h"]))
    assert there.tolist() == [True, True, False, True, True, False, False, False] and at[there].tolist() == [1, 0, 3, 4]


def test_empty(spark):
    assert found(spark, [], []) == []
    assert found(spark, [(1, "a:1", "a:2", 1)], []) == [(1, "dst", "a", "2025-01", "missing"), (1, "src", "a", "2025-01", "missing")]
    assert found(spark, [], [("a:1", 1, 2)]) == []


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from("abcd"), st.one_of(st.none(), st.integers(1, 9))), max_size=12),
    st.lists(st.tuples(st.sampled_from("abc"), st.one_of(st.none(), st.integers(1, 9)), st.one_of(st.none(), st.integers(1, 9))), max_size=8),
)
def test_against_plain_rule(spark, edges, parents):
    edges = [(k, *e) for k, e in enumerate(edges)]
    want = []
    for k, s, d, at in edges:
        for end, i in (("src", s), ("dst", d)):
            own = [p for p in parents if p[0] == i]
            seen = [p for p in own if at and p[1] and p[1] <= at]
            if own and (at is None or any(p[2] is None or p[2] > at for p in seen)):
                continue
            want.append((k, end, "unknown", "2025-01" if at else "none", "missing" if not own else "deleted" if seen else "late"))
    assert found(spark, edges, parents) == sorted(want)


def test_report(spark):
    f = spark.createDataFrame([(1, "src", "f", "2025-01", "late"), (1, "dst", "f", "2025-01", "late")], "edge_id long, ref_end string, ref_table string, period string, ref_state string")
    assert [tuple(r) for r in orphans.orphan_report(f).collect()] == [("f", "2025-01", "late", 2, 1)]


C = "hash string, parent_hashes array<string>, node string, depth int"


def commits(spark, links):
    return spark.createDataFrame([(h, p, "clash", 7) for h, p in links], C)


def plain(links):
    key = lambda x: x.strip().lower()
    parent = {}
    for h, ps in links:
        if h and h.strip():
            real = [key(p) for p in ps or [] if p and p.strip()]
            parent[key(h)] = real[0] if real else None
    out = {}
    for h in parent:
        at, depth, seen = h, 0, set()
        while parent[at] in parent and at not in seen:
            seen.add(at)
            at, depth = parent[at], depth + 1
        out[h] = ("", -1) if at in seen else (at, depth)
    return out


LINKS = [
    ("a", None), ("b", ["A "]), ("c", [None, " ", " B"]), ("d", ["missing"]), ("e", ["f"]), ("f", ["e"]), ("g", ["e", "a"]), ("s", ["s"]), ("h", []), (None, ["a"]), (" ", ["a"]), ("b", ["A "]), ("m", ["c", "d"]),
]


def test_forest(spark):
    got = {r.hash: (r.root_hash, r.depth) for r in hierarchy.forest(commits(spark, LINKS)).collect()}
    assert got == plain(LINKS) and len(got) == 10
    assert hierarchy.forest(commits(spark, [])).count() == 0 and hierarchy.ancestors(commits(spark, [])).count() == 0 and hierarchy.paths(commits(spark, [])).count() == 0
    assert {tuple(r) for r in hierarchy.ancestors(commits(spark, LINKS)).collect()} == {("b", "a", 1), ("c", "b", 1), ("c", "a", 2), ("m", "c", 1), ("m", "b", 2), ("m", "a", 3)}
    assert {r.hash: r.path for r in hierarchy.paths(commits(spark, LINKS)).collect()} == {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"], "m": ["a", "b", "c", "m"], "d": ["d"], "h": ["h"]}


def test_long_chain_and_star(spark):
    links = [("0", None)] + [(str(i), [str(i - 1)]) for i in range(1, 70)] + [(f"s{i}", ["0"]) for i in range(100)]
    got = {r.hash: (r.root_hash, r.depth) for r in hierarchy.forest(commits(spark, links)).collect()}
    assert got == plain(links)
    assert hierarchy.ancestors(commits(spark, links)).count() == sum(d for _, d in got.values())
