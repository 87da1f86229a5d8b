"""The facade: one method per tool over the tables of a workspace, which lie as parquet below its state folder."""

from __future__ import annotations

import resource
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import __version__
from loomgraph.errors import LoomError, error
from loomgraph.functions import embed, text
from loomgraph.operators import changes, commits, extract, gate, graph, listing, policy, search, telemetry
from loomgraph.session import exists, move, remove
from loomgraph.sources import files as readers
from loomgraph.sources import sinks
from loomgraph.sources.model import EDGE_TYPES, KINDS

STATE = ".loomgraph"
#: Views around a node, for ad-hoc queries that name one.
AROUND = ["neighborhood", "reachable"]

# The tools whose calls are recorded.
METERED = frozenset(
    "map_code list_symbols unified_search impact_analysis query_memory query_graph query_changes get_workspace_statistics get_branch_metrics get_token_savings_report get_health_report".split()
)

SCHEMAS = {
    "code_file": "id string, path string, language string, size_bytes long, content_hash string, last_indexed_at timestamp_ntz",
    "symbols": "id string, kind string, name string, file_path string, line_start int, line_end int, signature string, docstring string, body_hash string, token_count int, embed_type string, embedding array<float>, summary string",
    "edges": "edge_type string, src string, dst string, import_path string, linked_by string, created_at timestamp_ntz",
    "content_record": "id string, content_type string, file_path string, content_hash string, content string, embedding array<float>, source_path string, file_size_bytes long, ingested_at timestamp_ntz",
    "commit_node": readers.COMMIT,
    "file_hash": "file_path string, content_hash string, size_bytes long, recorded_at timestamp_ntz",
}


class Workspace:
    """A work tree with its graph, documents, commits and usage events."""

    def __init__(self, spark: SparkSession, path: str, branch: str = "main", model: Callable[[list[str]], np.ndarray] | None = embed.hashed, store: str | None = None):
        """store: the folder of the tables, on any file system that Spark writes to; the work tree's state folder without it."""
        root = Path(path)
        if not root.is_dir():
            raise error("WorkspaceNotFound", path)
        self.spark, self.root, self.branch, self.model = spark, root.resolve(), branch, model
        self.config = readers.read_config(str(self.state / "config.toml"))
        self.role: str | None = None
        self.busy = False
        self.began = time.monotonic()
        self.calls: list[tuple[str, float]] = []
        self.base = (store or str(self.state / "db")).rstrip("/")
        self.last_flush: str | None = None
        self.watched, self.last_watched = 0, None

    # tables

    @property
    def state(self) -> Path:
        return self.root / STATE

    @property
    def folder(self) -> str:
        return f"{self.base}/{self.branch.replace('/', '__')}"

    def table(self, name: str) -> DataFrame:
        at = f"{self.folder}/{name}"
        return self.spark.read.schema(SCHEMAS[name]).parquet(at) if exists(self.spark, at) else self.spark.createDataFrame([], SCHEMAS[name])

    def store(self, name: str, df: DataFrame) -> None:
        """Write beside the old table, then take its place."""
        mark = uuid.uuid4().hex
        at, work, old = f"{self.folder}/{name}", f"{self.folder}/_{name}.{mark}", f"{self.folder}/_{name}.old.{mark}"
        wanted = self.spark.createDataFrame([], SCHEMAS[name]).columns
        df.select(*wanted).write.parquet(work)
        if exists(self.spark, at):
            move(self.spark, at, old)
        move(self.spark, work, at)
        remove(self.spark, old)

    def nodes(self) -> DataFrame:
        f = self.table("code_file").select("id", F.lit("code_file").alias("kind"), F.col("path").alias("name"), F.col("path").alias("file_path"))
        return self.table("symbols").select("id", "kind", "name", "file_path").unionByName(f)

    # calls

    def call(self, tool: str, **params):
        """Run a tool by name: policy first, then the tool; metered tools leave a usage event."""
        method = getattr(self, tool, None) if not tool.startswith("_") and tool in TOOLS else None
        if method is None:
            raise error("InvalidParams", f"{tool} is not implemented")
        if not self._allowed(tool):
            raise error("PolicyDenied", f"{self.role or '<anonymous>'} may not call {tool}")
        began = time.monotonic()
        outcome, result = "error", None
        try:
            result = method(**params)
            outcome = "success"
            return result
        finally:
            self.calls = [*self.calls, (tool, (time.monotonic() - began) * 1e6)][-telemetry.SAMPLES :]
            if tool in METERED:
                size = len(str(result))
                found = next((len(v) for k, v in (result or {}).items() if isinstance(v, list)), 0) if isinstance(result, dict) else 0
                sinks.append_usage(
                    str(self.usage_file()),
                    {"tool_name": tool, "timestamp": datetime.now(timezone.utc).isoformat(), "response_bytes": size, "estimated_tokens": size // text.TOKEN_BYTES, "symbols_returned": found, "results_returned": found, "branch": self.branch, "agent_role": self.role, "outcome": outcome},
                )

    def _allowed(self, tool: str) -> bool:
        rules = self.spark.createDataFrame([list(r) for r in self.config.policy_rules], "place int, agent_role string, allow array<string>, deny array<string>")
        if not self.config.policy_enabled:
            return True
        one = self.spark.createDataFrame([(tool, self.role)], "tool_name string, agent_role string")
        return policy.decisions(one, rules, True, self.config.policy_unmatched == "allow").first().allowed

    def usage_file(self, branch: str | None = None) -> Path:
        return self.state / "metrics" / (branch or self.branch).replace("/", "__") / "usage.jsonl"

    def _usage(self, branch: str | None = None) -> DataFrame:
        return readers.read_usage(self.spark, str(self.usage_file(branch))).withColumn("timestamp", F.to_timestamp("timestamp"))

    @staticmethod
    def _rows(df: DataFrame) -> list[dict]:
        """Rows of a bounded result."""
        return [r.asDict(recursive=True) for r in df.collect()]

    def _ready(self) -> None:
        if self.busy:
            raise error("IndexInProgress")

    # status

    def set_workspace(self, branch: str | None = None) -> dict:
        self.branch = branch or self.branch
        return {"workspace_id": str(uuid.uuid5(uuid.NAMESPACE_URL, f"{self.root}:{self.branch}")), "path": str(self.root), "hydrated": exists(self.spark, f"{self.folder}/symbols")}

    def get_daemon_status(self) -> dict:
        memory = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
        return {
            "version": __version__, "uptime_seconds": int(time.monotonic() - self.began), "active_workspaces": 1, "active_connections": 1, "memory_bytes": memory,
            "model_loaded": self.model is not None, "model_name": getattr(self.model, "__name__", None),
        }

    def get_workspace_status(self) -> dict:
        disk = self._disk().select(F.col("path").alias("file_path"), "content_hash", "size_bytes")
        stored = self.table("code_file").select(F.col("path").alias("file_path"), "content_hash", "size_bytes")
        stats = self._rows(listing.statistics(self.table("code_file"), self.table("symbols"), self.table("edges")))[0]
        return {
            "path": str(self.root), "branch": self.branch, "db_path": self.folder, "last_flush": self.last_flush, "stale_files": changes.is_stale(changes.classify(stored, disk)).first().stale,
            "connection_count": 1, "code_graph": {k: stats[k] for k in ("code_files", "functions", "classes", "interfaces", "edges")},
        }

    def _registry(self) -> readers.Registry | None:
        at = self.state / "registry.yaml"
        return readers.read_registry(str(at), str(self.root)) if at.exists() else None

    def get_workspace_statistics(self) -> dict:
        stats = self._rows(listing.statistics(self.table("code_file"), self.table("symbols"), self.table("edges")))[0]
        keys = ("symbols_with_embeddings", "total_symbols", "coverage_percent")
        out = {k: v for k, v in stats.items() if k not in keys} | {"embedding_status": {"enabled": self.model is not None, **{k: stats[k] for k in keys}}}
        try:
            registry = self._registry()
        except LoomError:  # a registry that cannot be read is none
            registry = None
        if registry:
            sources = [{"content_type": s.get("type"), "language": s.get("language"), "path": s.get("path"), "status": s["status"]} for s in registry.sources]
            out["registry"] = {"sources": sources, "total_sources": len(sources)}
        return out

    def offline_changes(self) -> DataFrame:
        """Changes of all tracked files since their hashes were recorded: file_path, kind, and both hashes."""
        return changes.classify(self.table("file_hash"), readers.tracked(self.spark, str(self.root)))

    def watch_event(self, count: int = 1) -> None:
        """Note events that a watcher's stream has brought, for the health report."""
        self.watched, self.last_watched = self.watched + count, datetime.now(timezone.utc).isoformat()

    # indexing

    def _disk(self) -> DataFrame:
        c = self.config
        return readers.tree(self.spark, str(self.root), c.supported_languages, c.exclude_patterns, c.max_file_size_bytes)

    def index_workspace(self, force: bool = False) -> dict:
        """Bring the graph up to the work tree: only changed files are parsed, only changed bodies embedded anew, links of tasks follow
        their symbols, and what belonged to deleted files goes."""
        self._ready()
        self.busy = True
        try:
            return self._index(force)
        finally:
            self.busy = False

    def sync_workspace(self) -> dict:
        return self.index_workspace(False)

    def _index(self, force: bool) -> dict:
        disk = self._disk().cache()
        old_files, old_symbols, old_edges = self.table("code_file"), self.table("symbols"), self.table("edges")
        known = old_files.select("path", "content_hash")
        states = changes.sync_states(disk, known.limit(0) if force else known, self.config.supported_languages, self.config.max_file_size_bytes)
        todo = disk.join(states.where("status = 'parse'"), "path", "left_semi").cache()
        gone = changes.missing(old_files, disk, "path").select("path").cache()
        touched = todo.select(F.col("path").alias("file_path")).unionByName(gone.select(F.col("path").alias("file_path")))
        now = F.lit(datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")
        file_id = F.concat(F.lit("code_file:"), F.left(F.sha2("path", 256), F.lit(16)))

        parsed = extract.symbols_of(todo)
        order = F.expr("row_number() over (partition by path, kind, name order by line_start)")
        named = parsed.withColumn("id", F.concat("kind", F.lit(":"), F.left(F.sha2(F.concat_ws("\n", "path", "kind", "name", order.cast("string")), 256), F.lit(32))))
        tier = text.tier(F.col("body"), F.col("token_count"), F.col("signature"), F.col("docstring"), self.config.token_limit)
        fresh = named.withColumn("t", tier).select(
            "id", "kind", "name", F.col("path").alias("file_path"), "line_start", "line_end", "signature", "docstring", "body_hash", "token_count", F.col("t.embed_type").alias("embed_type"), F.lit(None).cast("array<float>").alias("embedding"), F.col("t.summary").alias("summary")
        )
        carried = changes.carry_vectors(fresh, old_symbols).cache()
        done = carried.where("reused").drop("reused")
        open_ = carried.where("not reused").drop("reused")
        embedded = embed.with_embedding(open_, "summary", self.model).select(*done.columns) if self.model else open_
        kept = changes.delete(old_symbols, touched, "file_path")
        symbols = kept.unionByName(done).unionByName(embedded).cache()

        found = extract.edges_of(todo)
        by_file = found.withColumnRenamed("path", "file_path")
        edge = lambda df, kind: df.select(F.lit(kind).alias("edge_type"), "src", "dst")
        defines = fresh.select(F.concat(F.lit("code_file:"), F.left(F.sha2("file_path", 256), F.lit(16))).alias("src"), F.col("id").alias("dst"))
        calls = changes.link_calls(by_file.where("edge_type = 'calls'").select("file_path", F.col("src").alias("caller"), F.col("dst").alias("callee")), fresh)
        impls = changes.link_impls(by_file.where("edge_type = 'inherits_from'").select("file_path", F.col("src").alias("struct"), F.col("dst").alias("trait")), fresh)
        new_edges = edge(defines, "defines").unionByName(edge(calls, "calls")).unionByName(edge(impls, "inherits_from"))
        new_edges = new_edges.select("*", F.lit(None).cast("string").alias("import_path"), F.lit(None).cast("string").alias("linked_by"), now.alias("created_at"))
        old_links = old_edges.where("edge_type = 'concerns'").select(F.col("src").alias("task"), F.col("dst").alias("id"), "linked_by", "created_at")
        moved = old_symbols.join(touched, "file_path", "left_semi").select("id", "name", "body_hash", "file_path", "kind")
        relinked = changes.relink(old_links.select("task", "id").join(moved, "id"), symbols).cache()
        stay = old_links.join(moved.select("id"), "id", "left_anti").select(F.lit("concerns").alias("edge_type"), F.col("task").alias("src"), F.col("id").alias("dst"), F.lit(None).cast("string").alias("import_path"), "linked_by", "created_at")
        again = relinked.where("new_id is not null").select(F.lit("concerns").alias("edge_type"), F.col("task").alias("src"), F.col("new_id").alias("dst"), F.lit(None).cast("string").alias("import_path"), F.lit("sync").alias("linked_by"), now.alias("created_at"))
        of_old = old_edges.where("edge_type <> 'concerns'").join(moved.select(F.col("id").alias("src")), "src", "left_anti").join(moved.select(F.col("id").alias("dst")), "dst", "left_anti").select(*new_edges.columns)
        files_new = todo.select(file_id.alias("id"), "path", "language", "size_bytes", "content_hash", now.alias("last_indexed_at"))
        files = changes.delete(changes.delete(old_files, todo, "path"), gone, "path").unionByName(files_new)
        edges = of_old.unionByName(new_edges).unionByName(stay).unionByName(again).dropDuplicates(["edge_type", "src", "dst", "import_path"])
        alive = symbols.select("id").unionByName(files.select("id")).distinct()
        edges = edges.join(alive.withColumnRenamed("id", "dst"), "dst", "left_semi")

        counts = {r.status: r.n for r in states.groupBy("status").agg(F.count("*").alias("n")).collect()}
        how = {r.how: r.n for r in relinked.groupBy("how").agg(F.count("*").alias("n")).collect()}
        out = {
            "files_parsed": counts.get("parse", 0),
            "files_unchanged": counts.get("unchanged", 0),
            "files_skipped": sum(v for k, v in counts.items() if k not in ("parse", "unchanged")),
            "files_deleted": gone.count(),
            "symbols_reused": carried.where("reused").count(),
            "symbols_embedded": carried.where("not reused").count(),
            "imports_found": found.where("edge_type = 'imports'").count(),
            "concerns_relinked": how.get("identity", 0) + how.get("name", 0),
            "concerns_orphaned": how.get("orphaned", 0),
        }
        tables = {"symbols": symbols, "edges": edges, "code_file": files}
        ready = {n: df.persist() for n, df in tables.items()}
        out |= {"symbols": ready["symbols"].count(), "edges": ready["edges"].count()}
        for n, df in ready.items():
            self.store(n, df)
        self.store("file_hash", readers.tracked(self.spark, str(self.root)))
        for df in (*ready.values(), disk, todo, gone, carried, relinked):
            df.unpersist()
        return out

    def ingest(self, source_path: str, content_type: str, pattern: str | None = None, most_bytes: int | None = None) -> dict:
        """Bring the content records of one source up to date: unchanged hashes are skipped, records of removed files go."""
        rows = readers.documents(self.spark, str(self.root), source_path, content_type, pattern, most_bytes or self.config.max_file_size_bytes)
        old = self.table("content_record")
        mine = old.where(F.col("source_path") == source_path)
        same = rows.join(mine.select("file_path", "content_hash"), ["file_path", "content_hash"], "left_semi").select("file_path")
        new = rows.join(same, "file_path", "left_anti").withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("ingested_at", F.current_timestamp().cast("timestamp_ntz"))
        if self.model:
            new = embed.backfill(new, self.model)
        removed = changes.missing(mine, rows, "file_path")
        out = {"ingested": new.count(), "unchanged": same.count(), "removed": removed.count()}
        kept = changes.delete(changes.delete(old, removed, "file_path"), new, "file_path")
        self.store("content_record", kept.unionByName(new.select(*kept.columns)))
        return out

    def ingest_sources(self) -> dict:
        """Ingest every active source of the registry; sources that are missing or outside the work tree are named, not read."""
        registry = self._registry()
        out = {"ingested": 0, "unchanged": 0, "removed": 0, "skipped": []}
        for s in registry.sources if registry else []:
            if s["status"] != "active":
                out["skipped"].append({"path": s.get("path"), "status": s["status"]})
                continue
            one = self.ingest(str(s["path"]), str(s.get("type") or "doc"), s.get("pattern"), registry.max_file_size_bytes)
            out |= {k: out[k] + v for k, v in one.items()}
        return out

    def flush_state(self) -> dict:
        """Write nodes.jsonl and edges.jsonl."""
        at = self.state / "graph"
        at.mkdir(parents=True, exist_ok=True)
        nodes = sinks.write_lines(sinks.node_lines(self.table("code_file"), self.table("symbols")), str(at / "nodes.jsonl"))
        edges = sinks.write_lines(sinks.edge_lines(self.table("edges")), str(at / "edges.jsonl"))
        self.last_flush = datetime.now(timezone.utc).isoformat()
        return {"files_written": [str(at / n) for n in ("nodes.jsonl", "edges.jsonl")], "warnings": [], "flush_timestamp": self.last_flush, "code_graph": {"nodes_written": nodes, "edges_written": edges}}

    def hydrate(self) -> dict:
        """Load the graph from nodes.jsonl and edges.jsonl; bodies' lines are not in them, corrupt lines are counted."""
        at = self.state / "graph"
        if not (at / "nodes.jsonl").exists():
            raise error("HydrationFailed", str(at))
        nodes, bad = readers.read_nodes(self.spark, str(at / "nodes.jsonl"))
        edges, worse = readers.read_edges(self.spark, str(at / "edges.jsonl")) if (at / "edges.jsonl").exists() else (self.spark.createDataFrame([], readers.EDGE), bad.limit(0))
        time_of = lambda c: F.to_timestamp(c).cast("timestamp_ntz")
        self.store("code_file", nodes.where("type = 'code_file'").withColumn("last_indexed_at", time_of("last_indexed_at")))
        self.store("symbols", nodes.where(F.col("type").isin(*KINDS)).withColumnRenamed("type", "kind"))
        self.store("edges", edges.select(F.col("type").alias("edge_type"), F.col("from").alias("src"), F.col("to").alias("dst"), "import_path", "linked_by", time_of("created_at").alias("created_at")).distinct())
        return {"nodes_loaded": nodes.count(), "edges_loaded": edges.count(), "lines_skipped": bad.count() + worse.count()}

    # reading

    def _depth(self, depth: int, nodes: int) -> tuple[int, int]:
        return min(max(depth, 1), self.config.max_traversal_depth), min(max(nodes, 1), self.config.max_traversal_nodes)

    def map_code(self, symbol_name: str, depth: int = 1, max_nodes: int = 50) -> dict:
        """The neighbourhood of a symbol. Several of that name are listed instead; for none the nearest by meaning are."""
        self._ready()
        depth, most = self._depth(depth, max_nodes)
        out = {"root": None, "neighbors": [], "edges": [], "truncated": False, "fallback_used": False, "matches": [], "effective_depth": depth, "effective_max_nodes": most}
        s = self.table("symbols")
        matches = self._rows(listing.by_name(s, symbol_name).select("id", "kind", "name", "file_path", "line_start", "line_end", "signature", "docstring", "summary").limit(most + 1))
        if not matches:
            if self.model:
                out["matches"] = self._rows(search.nearest_symbols(s, embed.embed_text(symbol_name, self.model), 10))
            return out | {"fallback_used": True}
        if len(matches) > 1:
            return out | {"matches": matches}
        near, truncated = graph.neighbourhood(self.nodes(), self.table("edges"), matches[0]["id"], depth, most)
        rows = self._rows(near.orderBy("depth", "found"))
        edges = [{"type": r["edge_type"], "from": r["src"], "to": r["dst"]} for r in rows]
        return out | {"root": matches[0], "neighbors": [{k: r[k] for k in ("id", "kind", "name", "file_path", "depth")} for r in rows], "edges": edges, "truncated": truncated}

    def list_symbols(self, file_path: str | None = None, node_type: str | None = None, name_prefix: str | None = None, limit: int = 50, offset: int = 0) -> dict:
        self._ready()
        where = listing.symbol_filter(file_path, node_type, name_prefix)
        limit, offset = min(max(limit, 1), listing.PAGE_MOST), max(offset, 0)
        s = self.table("symbols")
        n = listing.total(s, where, limit, offset).first()
        if name_prefix and not n.total_count:
            raise error("SymbolNotFound", name_prefix)
        rows = self._rows(listing.page(s, where, limit, offset).withColumnRenamed("kind", "type").drop("id"))
        return {"symbols": rows, "total_count": n.total_count, "has_more": n.has_more}

    def impact_analysis(self, symbol_name: str, depth: int = 1, max_nodes: int = 50, concept: str | None = None) -> dict:
        self._ready()
        depth, most = min(max(depth, 1), self.config.max_traversal_depth), min(max(max_nodes, 1), 100, self.config.max_traversal_nodes)
        s = self.table("symbols")
        first = listing.by_name(s, symbol_name).first()
        if first is None:
            raise error("SymbolNotFound", symbol_name)
        near, _ = graph.neighbourhood(self.nodes(), self.table("edges"), first.id, depth, most)
        out = {"symbol": {"name": first.name, "type": first.kind, "file_path": first.file_path}, "code_neighborhood": self._rows(near.orderBy("depth", "found").select("id", "kind", "name", "file_path", "depth")), "effective_depth": depth, "effective_max_nodes": most}
        if concept and self.model:
            hits = graph.reachable_nearest(s, self.table("edges"), first.id, depth, embed.embed_text(concept, self.model), most)
            out["hybrid_results"] = self._rows(hits.withColumnRenamed("score", "relevance_score"))
        return out

    def unified_search(self, query: str, region: str = "all", limit: int = 10, content_type: str | None = None, scope_to_symbol: str | None = None) -> dict:
        query = search.checked_query(query)
        s, r = self.table("symbols"), self.table("content_record")
        if scope_to_symbol:
            first = listing.by_name(s, scope_to_symbol).first()
            if first is not None:
                s = s.join(graph.reachable(self.table("edges"), first.id, 2), "id", "left_semi")
        rows = self._rows(search.unified(s, r, query, embed.embed_text(query, self.model) if self.model else None, limit, region, content_type))
        return {"results": rows, "total_count": len(rows), "total_matches": len(rows)}

    def query_memory(self, query: str, limit: int = 10, content_type: str | None = None) -> dict:
        if len(query.encode()) > text.QUERY_BYTES:
            raise error("QueryTooLong")
        r = self.table("content_record")
        r = r.where(F.col("content_type") == content_type) if content_type else r
        hits = search.hybrid_search(r, query, embed.embed_text(query, self.model) if self.model and query.strip() else None, limit)
        return {"results": self._rows(hits.join(r.select("id", "content"), "id").orderBy(F.desc("score"), "id"))}

    def query_graph(self, query: str, params: dict | None = None) -> dict:
        """A read-only SQL query over the tables, over each kind and edge type as a view of its own, and, with params `root` and `depth`, over
        two views around a node: neighborhood (id, kind, name, file_path, depth) and reachable (id, kind, name, file_path)."""
        views = [*SCHEMAS, *KINDS, *EDGE_TYPES]
        for name in SCHEMAS:
            self.table(name).createOrReplaceTempView(name)
        for kind in KINDS:
            self.table("symbols").where(F.col("kind") == kind).createOrReplaceTempView(kind)
        for e in EDGE_TYPES:
            self.table("edges").where(F.col("edge_type") == e).createOrReplaceTempView(e)
        if params and params.get("root"):
            depth = min(max(int(params.get("depth", 1)), 1), self.config.max_traversal_depth)
            gate.check_plan(self.spark, query.strip().rstrip(";"), [*views, *AROUND]) if query.strip() else None
            near, _ = graph.neighbourhood(self.nodes(), self.table("edges"), params["root"], depth, None)
            near.select("id", "kind", "name", "file_path", "depth").createOrReplaceTempView("neighborhood")
            self.nodes().join(graph.reachable(self.table("edges"), params["root"], depth), "id", "left_semi").createOrReplaceTempView("reachable")
            views += AROUND
        return gate.run(self.spark, query, self.config.query_row_limit, self.config.query_timeout_ms, views)

    def index_git_history(self, depth: int | None = None, force: bool = False) -> dict:
        began = time.monotonic()
        if depth == 0:
            raise error("InvalidParams", "depth")
        old = self.table("commit_node")
        mark = None if force else commits.latest_hash(old).first().hash
        new = readers.read_git(self.spark, str(self.root), depth or 500, mark)
        new = new.cache() if force else changes.delete(new, old, "hash").cache()  # commits of one second have no order
        t = commits.change_totals(new).first()
        self.store("commit_node", changes.delete(old, new, "hash").unionByName(new))
        return {"commits_indexed": self.table("commit_node").count(), "new_commits": t.commits, "total_changes": t.changes or 0, "elapsed_ms": int((time.monotonic() - began) * 1000)}

    def query_changes(self, file_path: str | None = None, symbol: str | None = None, since: str | None = None, until: str | None = None, limit: int = 20) -> dict:
        """Commits that touch a file, or the file of a symbol; else those of a time range. With a file or symbol the range is not used."""
        commits.parse_time(since), commits.parse_time(until)
        c = self.table("commit_node").withColumn("committed_at", F.col("committed_at").cast("timestamp_ntz"))
        if symbol:
            first = listing.by_name(self.table("symbols"), symbol).first()
            if first is None:
                raise error("SymbolNotFound", symbol)
            file_path = first.file_path
        rows = commits.touching(c, file_path) if file_path else commits.in_range(c, since, until)
        found = self._rows(commits.newest(rows, limit))
        return {"commits": found, "total": len(found), "file_path": file_path, "symbol": symbol}

    # reports

    def get_health_report(self) -> dict:
        status = self.get_daemon_status()
        out = {k: status[k] for k in ("version", "uptime_seconds", "active_connections", "model_loaded", "model_name")}
        out |= {"workspace_id": self.set_workspace()["workspace_id"], "tool_call_count": len(self.calls), "memory_mb": status["memory_bytes"] >> 20, "watcher_events": self.watched, "last_watcher_event": self.last_watched}
        out["embedding_status"] = {"enabled": self.model is not None} | self._rows(listing.coverage(self.table("symbols")))[0]
        out["metrics_summary"] = {"branch": self.branch, "summary": self._summary(None)} if self.usage_file().exists() else None
        if self.calls:
            e = self.spark.createDataFrame(self.calls, "tool_name string, elapsed_ms double")
            out["query_timing"] = {r["tool_name"]: r for r in self._rows(telemetry.query_timing(e))}
            p = telemetry.latency_percentiles(e.withColumn("tool_name", F.lit("all"))).first()
            out["latency_us"] = {"p50": p.p50, "p95": p.p95, "p99": p.p99}
        return out

    def _summary(self, branch: str | None) -> dict:
        e = self._usage(branch)
        return self._rows(telemetry.totals(e))[0] | {"by_tool": {r["tool_name"]: r for r in self._rows(telemetry.by_tool(e).orderBy("tool_name"))}, "top_tools": self._rows(telemetry.top_tools(e))}

    def get_branch_metrics(self, branch_name: str | None = None, compare_to: str | None = None) -> dict:
        out = {"branch_name": branch_name or self.branch, "summary": self._summary(branch_name)}
        if compare_to:
            both = self._usage(branch_name).withColumn("branch", F.lit("a")).unionByName(self._usage(compare_to).withColumn("branch", F.lit("b")))
            d = telemetry.compare_branches(both, "a", "b").first()
            out |= {"comparison": self._summary(compare_to), "delta": {"tool_calls": d.delta_calls, "tokens": d.delta_tokens}}
        return out

    def get_token_savings_report(self) -> dict:
        return {"branch": self.branch, "report": telemetry.token_report(self._usage().withColumn("branch", F.lit(self.branch))).first().report}

    def get_evaluation_report(self) -> dict:
        e = self._usage()
        agents = telemetry.efficiency(e).cache()
        odd = telemetry.anomalies(agents, telemetry.hammering(e))
        out = {"branch": self.branch, "efficiency_score": telemetry.overall_score(agents).first().efficiency_score, "agents": self._rows(agents.orderBy("agent_role")), "anomalies": self._rows(odd), "recommendations": self._rows(telemetry.recommendations(agents, odd)), "evaluated_at": datetime.now(timezone.utc).isoformat()}
        agents.unpersist()
        return out


TOOLS = frozenset(
    "set_workspace ingest_sources get_daemon_status get_workspace_status get_workspace_statistics index_workspace sync_workspace flush_state map_code list_symbols impact_analysis unified_search "
    "query_memory query_graph get_health_report get_branch_metrics get_token_savings_report get_evaluation_report query_changes index_git_history".split()
)
