import json
import subprocess
from datetime import datetime

import pytest

from loomgraph.engine import Workspace
from loomgraph.errors import LoomError
from loomgraph.operators import gate
from loomgraph.sources import files, sinks

A = "/// Adds.\npub fn add(a: u32) -> u32 { twice(a) }\nfn twice(a: u32) -> u32 { a }\npub struct Box1 { a: u32 }\npub trait Shape { }\nimpl Shape for Box1 { }\n"


def fails(name, f, *args, **kw):
    with pytest.raises(LoomError) as e:
        f(*args, **kw)
    assert e.value.name == name, e.value.body()
    assert e.value.body()["code"] == e.value.code


@pytest.fixture()
def ws(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.rs").write_text(A)
    (tmp_path / "src/b.rs").write_text("fn lone() { }\n")
    (tmp_path / "src/c.py").write_text("def f(): pass\n")
    (tmp_path / "target").mkdir()
    (tmp_path / "target/x.rs").write_text("fn no() {}")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/one.md").write_text("# One\nadding numbers twice")
    (tmp_path / "docs/two.md").write_text("# Two\nother things")
    return Workspace(spark, str(tmp_path))


def test_engine(ws, spark):
    out = ws.call("index_workspace")
    assert (out["files_parsed"], out["symbols"], out["edges"]) == (2, 5, 7)
    assert ws.call("sync_workspace")["files_unchanged"] == 2
    m = ws.call("map_code", symbol_name="add")
    assert {n["name"] for n in m["neighbors"]} == {"twice", "src/a.rs"} and not m["truncated"]
    assert ws.call("map_code", symbol_name="nothing like it")["fallback_used"]
    assert ws.call("list_symbols", node_type="function")["total_count"] == 3
    fails("SymbolNotFound", ws.call, "list_symbols", name_prefix="zzz")
    i = ws.call("impact_analysis", symbol_name="twice", depth=2, concept="box")
    assert {n["name"] for n in i["code_neighborhood"]} >= {"add", "src/a.rs", "Box1"} and i["hybrid_results"] == []
    fails("SymbolNotFound", ws.call, "impact_analysis", symbol_name="zzz")
    assert ws.ingest("docs", "doc", "*.md") == {"ingested": 2, "unchanged": 0, "removed": 0}
    (ws.root / "docs/two.md").unlink()
    assert ws.ingest("docs", "doc") == {"ingested": 0, "unchanged": 1, "removed": 1}
    assert ws.call("unified_search", query="adding numbers")["results"][0]["id"].startswith("cr_")
    assert ws.call("unified_search", query="adding", scope_to_symbol="add")["total_count"] >= 1
    assert ws.call("query_memory", query="numbers")["results"][0]["content"].startswith("# One")
    fails("QueryEmpty", ws.call, "unified_search", query=" ")
    q = ws.call("query_graph", query="SELECT kind, count(*) AS n FROM symbols GROUP BY kind ORDER BY kind;")
    assert q["rows"] == [{"kind": "class", "n": 1}, {"kind": "function", "n": 3}, {"kind": "interface", "n": 1}] and not q["truncated"]
    fails("QueryRejected", ws.call, "query_graph", query="DELETE FROM symbols")
    stats = ws.call("get_workspace_statistics")
    assert stats["functions"] == 3 and stats["embedding_status"]["coverage_percent"] == 100.0
    assert not ws.call("get_workspace_status")["stale_files"]

    # links of tasks follow their symbols; deleted files take theirs along
    task = spark.createDataFrame([("concerns", "task:1", ws.table("symbols").where("name = 'twice'").first().id, None, None, None)], "edge_type string, src string, dst string, import_path string, linked_by string, created_at timestamp_ntz")
    ws.store("edges", ws.table("edges").unionByName(task).cache())
    (ws.root / "src/a.rs").write_text("// moved\n\n" + A)
    (ws.root / "src/b.rs").unlink()
    out = ws.call("sync_workspace")
    assert (out["files_parsed"], out["files_deleted"], out["symbols_reused"], out["concerns_relinked"], out["symbols"]) == (1, 1, 4, 1, 4)
    assert ws.table("edges").where("edge_type = 'concerns'").count() == 1

    flushed = ws.call("flush_state")["code_graph"]
    before = sorted(map(str, ws.table("symbols").drop("embedding").collect()))
    assert flushed["nodes_written"] == 5
    lines = (ws.state / "graph/nodes.jsonl").read_text().splitlines()
    assert lines == sorted(lines) and all("body" not in json.loads(x) for x in lines)
    with (ws.state / "graph/nodes.jsonl").open("a") as f:
        f.write("\n{broken\n")
    again = ws.hydrate()
    assert again == {"nodes_loaded": 5, "edges_loaded": flushed["edges_written"], "lines_skipped": 1}
    assert sorted(map(str, ws.table("symbols").drop("embedding").collect())) == before

    assert ws.call("get_branch_metrics")["summary"]["total_tool_calls"] > 5
    assert "Calls:" in ws.call("get_token_savings_report")["report"]
    assert 0 <= ws.call("get_evaluation_report")["efficiency_score"] <= 100
    assert ws.call("get_health_report")["tool_call_count"] > 5
    fails("MetricsNotFound", ws.call, "get_branch_metrics", branch_name="other")
    fails("InvalidParams", ws.call, "unknown_tool")
    ws.config.policy_enabled = True
    fails("PolicyDenied", ws.call, "map_code", symbol_name="add")
    fails("WorkspaceNotFound", Workspace, spark, "/nowhere")


def test_status_and_sources(ws, spark):
    ws.call("index_workspace")
    assert {r.file_path for r in ws.table("file_hash").collect()} == {"src/a.rs", "src/b.rs", "src/c.py", "docs/one.md", "docs/two.md"}
    assert ws.offline_changes().count() == 0
    (ws.root / "docs/one.md").write_text("# One\nchanged")
    (ws.root / "docs/two.md").unlink()
    (ws.root / "docs/three.md").write_text("# Three\nadding words")
    assert {(r.path, r.kind) for r in ws.offline_changes().withColumnRenamed("file_path", "path").collect()} == {("docs/one.md", "modified"), ("docs/two.md", "deleted"), ("docs/three.md", "added")}
    (ws.state / "registry.yaml").write_text("sources:\n- {type: doc, path: docs}\n- {type: doc, path: nowhere}\n")
    assert ws.call("ingest_sources") == {"ingested": 2, "unchanged": 0, "removed": 0, "skipped": [{"path": "nowhere", "status": "missing"}]}
    assert ws.call("get_workspace_statistics")["registry"]["total_sources"] == 2
    ws.watch_event(3)
    h = ws.call("get_health_report")
    assert h["watcher_events"] == 3 and h["memory_mb"] > 0 and h["version"] and h["embedding_status"]["total_symbols"] == 5 and h["metrics_summary"]["branch"] == "main"
    ws.call("flush_state")
    s = ws.call("get_workspace_status")
    assert s["last_flush"] and s["db_path"].endswith("db/main") and s["connection_count"] == 1
    root = ws.table("symbols").where("name = 'add'").first().id
    q = ws.call("query_graph", query="SELECT name FROM neighborhood JOIN file_hash USING (file_path) ORDER BY name", params={"root": root, "depth": 2})
    assert [r["name"] for r in q["rows"]] == ["Box1", "Shape", "src/a.rs", "twice"]
    assert [r["name"] for r in ws.call("query_graph", query="SELECT name FROM reachable", params={"root": root})["rows"]] == ["twice"]
    fails("QueryInvalid", ws.call, "query_graph", query="SELECT name FROM reachable")


def test_store_elsewhere(ws, spark, tmp_path):
    other = Workspace(spark, str(ws.root), store=f"file:{tmp_path}/far/away")
    assert other.call("index_workspace")["symbols"] == 5 and (tmp_path / "far/away/main/symbols").is_dir() and not (ws.state / "db").exists()
    assert other.call("sync_workspace")["files_unchanged"] == 2


def test_ignore_files(spark, tmp_path):
    names = "a.rs build/x.rs keep/build/y.rs gen/a.rs gen/deep/b.rs gen/keep.rs logs/z.rs sub/own.rs sub/other.rs out.rs sub/out.rs doc/a/b/q.rs t1.rs t9.rs [x].rs"
    for n in names.split():
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("fn a() {}")
    (tmp_path / ".gitignore").write_text("# comment\n\nbuild/\n/out.rs\ngen/*\n!gen/keep.rs\nlogs\n!logs/z.rs\ndoc/**/q.rs\nt[0-5].rs\n\\[x].rs\n")
    (tmp_path / "sub/.gitignore").write_text("own.rs\n")
    everything = set(names.split())
    paths = lambda: {r.path for r in files.tree(spark, str(tmp_path)).collect()}
    assert paths() == everything  # not a repository
    (tmp_path / ".ignore").write_text("t9.rs\n")
    assert paths() == everything - {"t9.rs"}
    (tmp_path / ".git/info").mkdir(parents=True)
    assert paths() == {"a.rs", "gen/keep.rs", "sub/other.rs", "sub/out.rs"}
    (tmp_path / ".git/info/exclude").write_text("a.rs\n")
    assert paths() == {"gen/keep.rs", "sub/other.rs", "sub/out.rs"}


def test_sqlite_and_project(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "s.db") as con:
        con.execute("CREATE TABLE turns (session_id TEXT, turn_index INTEGER, text TEXT)")
        con.executemany("INSERT INTO turns VALUES (?, ?, ?)", [(f"s{k % 3}", k, None if k == 4 else f"t{k}") for k in range(25)])
        con.execute("DELETE FROM turns WHERE turn_index = 7")
        con.execute("CREATE TABLE none (a TEXT)")
    got = files.read_sqlite(spark, str(tmp_path / "s.db"), "turns", "session_id string, turn_index int, text string", rows_per_task=10)
    assert sorted((r.session_id, r.turn_index, r.text) for r in got.collect()) == sorted((f"s{k % 3}", k, None if k == 4 else f"t{k}") for k in range(25) if k != 7)
    assert got.rdd.getNumPartitions() == 3 and files.read_sqlite(spark, str(tmp_path / "s.db"), "none", "a string").count() == 0
    logs = spark.createDataFrame([("2", "second", None), ("1", "first", "todo")], "id string, title string, status string")
    out = sinks.write_project(str(tmp_path / "p"), "name", None, None, "main", logs)
    assert json.loads((tmp_path / "p/project.json").read_text()) == out and [b["id"] for b in out["backlogs"]] == ["1", "2"]
    assert sinks.refresh_backlog(str(tmp_path / "p"), logs.replace("first", "renamed"), "1") and not sinks.refresh_backlog(str(tmp_path / "p"), logs, "9")
    assert [(r.id, r.title) for r in files.read_backlogs(spark, str(tmp_path / "p")).collect()] == [("1", "renamed"), ("2", "second")]


def test_git(ws):
    run = lambda *a: subprocess.run(["git", "-C", str(ws.root), "-c", "user.name=t", "-c", "user.email=t@invalid", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "src")
    run("commit", "-qm", "one")
    (ws.root / "src/b.rs").write_text("fn lone() { let a = 1; }\n")
    run("commit", "-qam", "two")
    out = ws.call("index_git_history")
    assert (out["new_commits"], out["total_changes"]) == (2, 4)
    assert ws.call("index_git_history")["new_commits"] == 0
    got = ws.call("query_changes", file_path="src/b.rs")["commits"]
    assert [c["message"] for c in sorted(got, key=lambda c: c["message"])] == ["one", "two"]
    change = next(c for c in got if c["message"] == "two")["changes"][0]
    assert (change["change_type"], change["lines_added"], change["lines_removed"]) == ("modify", 1, 1)
    fails("InvalidParams", ws.call, "query_changes", since="never")
    fails("InvalidParams", ws.call, "index_git_history", depth=0)


def test_gate(spark):
    for q in ("INSERT INTO t VALUES (1)", "delete from t", "UPDATE t SET a=1", "DEFINE x", "RELATE a", "SELECT 1; DROP", "create table x as select 1"):
        with pytest.raises(LoomError) as e:
            gate.run(spark, q)
        assert e.value.name in ("QueryRejected", "QueryInvalid")
    fails("QueryRejected", gate.run, spark, "SET spark.x=1")
    fails("QueryRejected", gate.run, spark, "DROP TABLE x")
    fails("QueryInvalid", gate.run, spark, "SELECT 'open")
    fails("QueryEmpty", gate.run, spark, "  ")
    fails("QueryInvalid", gate.run, spark, "SELECT nothing FROM nowhere")
    assert gate.run(spark, "SELECT 'DELETE me' AS v")["rows"] == [{"v": "DELETE me"}]
    assert gate.run(spark, "SELECT id AS updated_at FROM range(10)", row_limit=3)["truncated"]


def test_gate_reads_views_only(spark):
    """What reads or runs anything beside the views is rejected before it is analysed."""
    spark.range(5).createOrReplaceTempView("five")
    spark.udf.register("own_function", lambda x: x)
    for q in (
        "SELECT * FROM text.`/etc/hostname`",
        "SELECT * FROM five WHERE id = (SELECT max(_c0) FROM csv.`/etc/hostname`)",
        "WITH a AS (SELECT * FROM parquet.`/tmp`) SELECT * FROM a",
        "SELECT * FROM default.five",
        "SELECT java_method('java.lang.System', 'getenv', 'HOME')",
        "SELECT (SELECT reflect('java.lang.System', 'getenv', 'HOME'))",
        "SELECT * FROM five ORDER BY try_reflect('java.lang.System', 'getenv', 'HOME')",
        "SELECT IDENTIFIER('java_method')('java.lang.System', 'getenv', 'HOME')",
        "SELECT * FROM IDENTIFIER('five')",
        "SELECT own_function(id) FROM five",
        "SELECT raise_error('x')",
        "SELECT TRANSFORM(id) USING 'cat' FROM five",
        "SELECT * FROM five LATERAL VIEW java_method('java.lang.System', 'getenv', 'HOME') t AS x",
        "SELECT * FROM sql_keywords()",
        "SHOW TABLES",
        "EXPLAIN SELECT 1",
        "CACHE TABLE five",
    ):
        fails("QueryRejected", gate.run, spark, q)
    fails("QueryInvalid", gate.run, spark, "SELECT * FROM five", views=["six"])
    for q, n in (
        ("WITH a AS (SELECT id FROM five), b AS (SELECT * FROM a) SELECT * FROM b WHERE id IN (SELECT id FROM a) AND EXISTS (SELECT 1 FROM five)", 5),
        ("SELECT count(*) AS n, max(id) OVER () AS m FROM five GROUP BY id HAVING count(*) > 0", 5),
        ("SELECT * FROM five LATERAL VIEW explode(array(1, 2)) t AS x", 10),
        ("SELECT id FROM five UNION ALL SELECT filter(array(9), x -> x > 1)[0]", 6),
    ):
        assert gate.run(spark, q)["row_count"] == n


def test_usage_file(spark, tmp_path):
    p = tmp_path / "u/usage.jsonl"
    fails("MetricsNotFound", files.read_usage, spark, str(p))
    for k in range(3):
        sinks.append_usage(str(p), {"tool_name": "a", "timestamp": "2025-01-01T00:00:00Z", "estimated_tokens": k})
    with p.open("a") as f:
        f.write('{"tool_name": "torn')
    assert files.read_usage(spark, str(p)).where("outcome = 'success'").count() == 3
    with p.open("a") as f:
        f.write("\n\n")
    p.write_text(p.read_text() + json.dumps({"tool_name": "b", "timestamp": "x"}) + "\n")
    fails("MetricsParseError", files.read_usage, spark, str(p))


def test_configuration(tmp_path):
    (tmp_path / "r.yaml").write_text("sources:\n- {type: docs, path: docs}\n- {type: docs, path: docs}\n- {type: x, path: ../up}\n- {type: x, path: gone}\n")
    (tmp_path / "docs").mkdir()
    assert [s["status"] for s in files.read_registry(str(tmp_path / "r.yaml"), str(tmp_path)).sources] == ["active", "error", "error", "missing"]
    (tmp_path / "r.yaml").write_text("batch_size: 501")
    fails("RegistryValidationFailed", files.read_registry, str(tmp_path / "r.yaml"), str(tmp_path))
    (tmp_path / "r.yaml").write_text("- just\n- a list")
    fails("RegistryParseFailed", files.read_registry, str(tmp_path / "r.yaml"), str(tmp_path))
    assert files.read_config(str(tmp_path / "none.toml")) == files.Config()
    (tmp_path / "c.toml").write_text('query_row_limit = 7\n[code_graph]\nsupported_languages = ["rust", "python"]\n[policy]\nenabled = true\nrules = [{agent_role = "a", deny = ["x"]}]')
    c = files.read_config(str(tmp_path / "c.toml"))
    assert (c.query_row_limit, c.supported_languages, c.policy_enabled, c.policy_rules) == (7, ("rust", "python"), True, ((0, "a", [], ["x"]),))
    (tmp_path / "c.toml").write_text("[batch]\nmax_size = 0")
    fails("ConfigInvalidValue", files.read_config, str(tmp_path / "c.toml"))


def test_readers(spark, tmp_path):
    for n, body in (("backlog-1.json", '{"id": "1", "title": "x"}'), ("backlog-2.json", "{nope"), ("other.json", "{}")):
        (tmp_path / n).write_text(body)
    assert [r.id for r in files.read_backlogs(spark, str(tmp_path)).collect()] == ["1"]
    (tmp_path / "specs/001-first").mkdir(parents=True)
    (tmp_path / "specs/001-first/spec.md").write_text("text\n# The title \nmore")
    (tmp_path / "specs/notes").mkdir()
    (tmp_path / "specs/notes/spec.md").write_text("# no")
    assert [(r.number, r.name, r.title) for r in files.read_features(spark, str(tmp_path / "specs")).collect()] == [("001", "first", "The title")]
    df = spark.createDataFrame([("a", datetime(2025, 1, 1)), ("b", None)], "x string, at timestamp_ntz")
    sinks.write_partitioned(df, str(tmp_path / "parts"), "x")
    sinks.write_partitioned(df.where("x = 'b'"), str(tmp_path / "parts"), "x")
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 2
    sinks.atomic_write(str(tmp_path / "new/s.json"), "{}")
    assert (tmp_path / "new/s.json").read_text() == "{}"
