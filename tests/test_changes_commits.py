from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomgraph.errors import LoomError
from loomgraph.operators import changes, commits, extract
from loomgraph.plans import activity

H = "file_path string, content_hash string, size_bytes long"


def test_classify(spark):
    stored = spark.createDataFrame([("same", "h", 1), ("size", "h", 1), ("hash", "h", 1), ("gone", "h", 1)], H)
    disk = spark.createDataFrame([("same", "h", 1), ("size", "h", 2), ("hash", "g", 1), ("new", "h", 1)], H)
    got = {r.path: (r.kind, r.previous_hash, r.current_hash) for r in changes.classify(stored, disk).collect()}
    assert got == {"size": ("modified", "h", "h"), "hash": ("modified", "h", "g"), "gone": ("deleted", "h", None), "new": ("added", None, "h")}
    assert {r.kind: r.n for r in changes.change_counts(changes.classify(stored, disk)).collect()} == {"modified": 2, "deleted": 1, "added": 1}
    assert not changes.is_stale(changes.classify(stored, stored)).first().stale
    assert [r.file_path for r in changes.missing(stored, disk, "file_path").collect()] == ["gone"]


def test_merge(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "id string, v int, version int")
    assert {tuple(r) for r in changes.upsert(base, new, "id").collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert {r.id for r in changes.delete(base, new, "id").collect()} == {"a"}


def test_vectors(spark):
    s = "id string, name string, body_hash string, embedding array<float>"
    old = spark.createDataFrame([("1", "f", "h", [0.0, 1.0]), ("2", "g", "h", [0.0, 0.0])], s)
    new = spark.createDataFrame([("3", "f", "h", None), ("4", "g", "h", None), ("5", "f", "x", [1.0, 0.0])], s)
    assert {r.id: (r.reused, r.embedding) for r in changes.carry_vectors(new, old).collect()} == {"3": (True, [0.0, 1.0]), "4": (False, None), "5": (False, [1.0, 0.0])}
    bad = spark.createDataFrame([("1", [1.0]), ("2", [float("nan")]), ("3", [float("inf")]), ("4", None)], "id string, embedding array<float>")
    kept, n = changes.drop_corrupt_vectors(bad)
    assert {r.id for r in kept.collect()} == {"1", "4"} and n.first().removed == 2
    up = changes.with_vectors(bad, spark.createDataFrame([("4", [2.0])], "id string, embedding array<float>"))
    assert {r.id: r.embedding for r in up.collect()}["4"] == [2.0]


def test_relink(spark):
    links = spark.createDataFrame([("t", "o1", "f", "h", "a", "function"), ("t", "o2", "g", "x", "a", "function"), ("t", "o3", "z", "z", "a", "function")], "task string, id string, name string, body_hash string, file_path string, kind string")
    new = spark.createDataFrame([("n1", "f", "h", "b", "function", 1), ("n2", "g", "y", "a", "function", 5), ("n3", "g", "y", "a", "class", 1)], "id string, name string, body_hash string, file_path string, kind string, line_start int")
    assert {(r.old_id, r.new_id, r.how) for r in changes.relink(links, new).collect()} == {("o1", "n1", "identity"), ("o2", "n2", "name"), ("o3", None, "orphaned")}


def test_edges(spark):
    e = spark.createDataFrame([("calls", "a", "b"), ("calls", "a", "x"), ("concerns", "t", "a"), ("concerns", "t", "b")], "edge_type string, src string, dst string")
    s = spark.createDataFrame([("a", "f", "p"), ("b", "g", "q")], "id string, name string, file_path string")
    assert {tuple(r) for r in changes.drop_dangling(e.where("edge_type='calls'"), s).select("src", "dst").collect()} == {("a", "b")}
    kept, gone = changes.unlink(e, s, "t", "f")
    assert kept.count() == 3 and [r.dst for r in gone.collect()] == ["a"]
    s2, e2 = changes.clear_file(s, e, "p")
    assert {r.id for r in s2.collect()} == {"b"} and {(r.src, r.dst) for r in e2.collect()} == {("t", "b")}


C = "hash string, committed_at timestamp_ntz, changes array<struct<file_path string, change_type string, lines_added int, lines_removed int>>"


def test_commits(spark):
    day = lambda d: datetime(2025, 1, d)
    c = spark.createDataFrame([("a", day(1), [("x", "add", 1, 0)]), ("b", day(2), []), ("c", day(3), None), ("d", day(3), [("x", "modify", 2, 1), ("y", "add", 1, 1)])], C)
    ids = lambda df: sorted(r.hash for r in df.collect())
    assert ids(commits.in_range(c, "2025-01-02T00:00:00Z", "2025-01-03T00:00:00+00:00")) == ["b", "c", "d"]
    assert [r.hash for r in commits.newest(c, 2).collect()] == ["c", "d"] and commits.newest(c, 0).count() == 4
    assert ids(commits.touching(c, "x")) == ["a", "d"] and commits.latest_hash(c).first().hash == "d" and commits.latest_hash(c.limit(0)).first().hash is None
    t = commits.change_totals(c).first()
    assert (t.commits, t.changes, t.lines_added, t.lines_removed) == (4, 3, 4, 2)
    assert ids(commits.after_watermark(c, c.where("hash = 'b'"))) == ["c", "d"] and commits.after_watermark(c, c.limit(0)).count() == 4
    with pytest.raises(LoomError):
        commits.in_range(c, "yesterday")
    p = spark.createDataFrame([("+a\n-b\n+++x\n c",)], "d string").select(commits.patch(F.col("d"), 2).alias("p")).first().p
    assert (p.snippet, p.lines_added, p.lines_removed) == ("+a\n-b\n[diff truncated]\n", 1, 1)


def test_long_patch(spark, monkeypatch):
    """The registered query keeps and counts all lines up to the operator's limit, and cuts there."""
    lines = ["+a", "-b"] * 200
    diffs = ["\n".join(lines), "\n".join(lines + lines)]
    c = spark.createDataFrame([("a", [(d,) for d in diffs])], "hash string, changes array<struct<diff_snippet string>>")
    monkeypatch.setattr(activity.model, "commits", lambda spark, folder: c)
    whole, cut = activity.commit_patches(spark, "").orderBy("place").collect()
    assert (whole.snippet, whole.lines_added, whole.lines_removed) == (diffs[0], 200, 200)
    assert (cut.snippet.count("\n"), cut.lines_added, cut.lines_removed) == (commits.DIFF_LINES + 1, 250, 250) and cut.snippet.endswith("\n[diff truncated]\n")


RUST = '''use crate::a::{B, C};
/// Says hello.
/// Twice.
#[inline]
pub fn hello(x: u32) -> u32 {
    // not_a_call(1)
    let s = "fn fake() { }";
    println!("{}", in_macro(1));
    helper(x) + util::deep::<u8>(x) + s.method(1) + Foo::new()
}
fn helper(x: u32) -> u32 { if (x > 1) { x } else { 2 } }
/** A thing. */
pub struct Foo<T> where T: Copy { a: T }
pub trait Shape { fn area(&self) -> f64; }
impl<T: Copy> Shape for Foo<T> {
    fn area(&self) -> f64 { helper(3) as f64 }
}
mod inner { fn hidden() {} }
'''


def test_rust():
    symbols, edges = extract.parse(RUST)
    assert [(s.kind, s.name, s.line_start, s.line_end) for s in symbols] == [("function", "hello", 5, 10), ("function", "helper", 11, 11), ("class", "Foo", 13, 13), ("interface", "Shape", 14, 14), ("function", "Foo<T>::area", 16, 16)]
    assert symbols[0].docstring == "Says hello.\nTwice." and symbols[0].signature == "pub fn hello(x: u32) -> u32" and symbols[2].docstring == "A thing."
    assert sorted((e.src, e.dst) for e in edges if e.edge_type == "calls") == [("Foo<T>::area", "helper"), ("hello", "deep"), ("hello", "helper")]
    assert [e.dst for e in edges if e.edge_type == "imports"] == ["crate::a::{B, C}"] and [(e.src, e.dst) for e in edges if e.edge_type == "inherits_from"] == [("Foo<T>", "Shape")]
    for broken in ("", "fn", "fn x(", "struct", "impl {", '"open', "/* open", "}}}", "#[", "use"):
        extract.parse(broken)


def test_symbols_and_calls(spark):
    files = spark.createDataFrame([("a.rs", RUST), ("a.rs", RUST), ("b.py", "def f(): pass"), ("c.rs", None)], "path string, source string")
    s = extract.symbols_of(files)
    assert s.count() == 5
    named = s.select(F.col("path").alias("file_path"), "kind", "name", "line_start", F.col("name").alias("id"))
    calls = extract.edges_of(files).where("edge_type = 'calls'").select(F.col("path").alias("file_path"), F.col("src").alias("caller"), F.col("dst").alias("callee"))
    assert {tuple(r) for r in changes.link_calls(calls, named).collect()} == {("hello", "helper"), ("Foo<T>::area", "helper")}
