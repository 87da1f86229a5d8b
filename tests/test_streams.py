import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loomgraph.streaming import watch

T0 = datetime(2025, 1, 1)


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in rows) + "\n")


def drain(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"select * from {name}")


def change(path, kind, ms, old=None):
    return {"path": path, "old_path": old, "kind": kind, "timestamp": (T0 + timedelta(milliseconds=ms)).isoformat()}


def test_relevant(spark):
    rows = [("a.rs", None, "created"), ("target/x", None, "modified"), ("target/y", "b.rs", "renamed"), ("c.rs", ".git/c", "renamed"), ("d.rs", "e.rs", "renamed"), ("z", None, "other")]
    df = spark.createDataFrame([(p, o, k, T0) for p, o, k in rows], "path string, old_path string, kind string, timestamp timestamp")
    got = {(r.path, r.old_path, r.kind) for r in watch.relevant(df).collect()}
    assert got == {("a.rs", None, "created"), ("b.rs", None, "deleted"), ("c.rs", None, "created"), ("d.rs", "e.rs", "renamed")}
    acts = {r.path: r.a for r in df.select("path", watch.action(F.col("path"), F.col("kind")).alias("a")).collect()}
    assert acts["a.rs"] == "reindex" and acts["z"] == "skip" and acts["c.rs"] == "skip"


def test_debounce_and_bursts(spark, tmp_path):
    rows = [change("a.rs", "created", 0), change("a.rs", "modified", 400), change("a.rs", "deleted", 2000), change("b.rs", "created", 100), change("end.rs", "created", 3_600_000)]
    write(tmp_path / "in", "1.json", rows)
    batch = spark.read.schema(watch.CHANGE).json(str(tmp_path / "in"))
    got = {(r.path, r.kind, r.events) for r in watch.debounced(batch).collect()}
    assert got == {("a.rs", "modified", 2), ("a.rs", "deleted", 1), ("b.rs", "created", 1), ("end.rs", "created", 1)}
    assert sorted(r.events for r in watch.bursts(batch).collect()) == [1, 4]
    # the stream closes what the watermark has passed
    out = drain(spark, watch.debounced(watch.changes(spark, str(tmp_path / "in"))), "debounced")
    assert {(r.path, r.kind, r.events) for r in out.collect()} == got - {("end.rs", "created", 1)}


def test_usage_stream(spark, tmp_path):
    at = lambda m: (T0 + timedelta(minutes=m)).isoformat() + "Z"
    rows = [{"tool_name": "a", "timestamp": at(m), "estimated_tokens": 5, "branch": b} for m, b in ((0, "x"), (1, "f/y"), (11, "x"), (200, "x"))]
    write(tmp_path / "in", "1.jsonl", [*rows, '{"tool_name": "torn'])
    q = watch.write_usage(watch.usage(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 4 and {r.branch_dir for r in back.select("branch_dir").distinct().collect()} == {"x", "f__y"}
    out = drain(spark, watch.windowed_usage(watch.usage(spark, str(tmp_path / "in"))), "windows")
    assert sorted((r.calls, r.tokens) for r in out.collect()) == [(1, 5), (2, 10)]


def test_bursts_call_synchronise(spark, tmp_path):
    write(tmp_path / "in", "1.json", [change("a.rs", "created", 0), change("a.rs", "modified", 1), change("b.md", "created", 2)])
    seen = []
    q = watch.on_each_burst(watch.changes(spark, str(tmp_path / "in")), lambda df, n: seen.append(sorted(r.path for r in df.collect())), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert seen == [["a.rs"]]


def test_idle(spark, tmp_path):
    rows = [("a", 0), ("a", 10), ("b", 0), ("b", 300), ("c", 900)]
    write(tmp_path / "in", "1.json", [{"workspace": w, "timestamp": (T0 + timedelta(minutes=m)).isoformat()} for w, m in rows])
    schema = "workspace string, timestamp timestamp"
    table, at = spark.read.schema(schema).json(str(tmp_path / "in")), F.lit(T0 + timedelta(minutes=545))
    assert {(r.workspace, r.last_at) for r in watch.idle(table, now=at).collect()} == {("a", T0 + timedelta(minutes=10)), ("b", T0 + timedelta(minutes=300))}
    assert watch.idle(table, 0, now=at).count() == 0
    out = drain(spark, watch.idle(spark.readStream.schema(schema).json(str(tmp_path / "in"))), "idle")
    assert sorted((r.workspace, r.idle_at) for r in out.collect()) == [("a", T0 + timedelta(minutes=250)), ("b", T0 + timedelta(minutes=240)), ("b", T0 + timedelta(minutes=540))]


def test_slots_against_sessions(spark):
    """Bursts counted by slots are those of session windows, ties and exact pauses included."""
    import random

    r = random.Random(3)
    rows, ms = [], 0
    for _ in range(400):
        ms += r.choice([0, 1, 500, 1999, 2000, 2001, 5000])
        rows.append((r.choice("xy"), T0 + timedelta(milliseconds=ms)))
    e = spark.createDataFrame(rows, "path string, timestamp timestamp")
    plain = e.groupBy("path", F.session_window("timestamp", "2 seconds").alias("w")).agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"), F.count("*").alias("n"))
    assert sorted(map(tuple, watch.bursts(e, key="path").collect())) == sorted(map(tuple, plain.select("path", "a", "b", "n").collect()))
    whole = e.groupBy(F.session_window("timestamp", "2 seconds").alias("w")).agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"), F.count("*").alias("n"))
    assert sorted(map(tuple, watch.bursts(e).collect())) == sorted(map(tuple, whole.select("a", "b", "n").collect()))
