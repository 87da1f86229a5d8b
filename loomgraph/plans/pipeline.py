"""Queries of validation, files, streams and embedding."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.errors import LoomError
from loomgraph.functions import embed, vector
from loomgraph.operators import changes, gate, graph, listing, policy
from loomgraph.plans import sqlparts as Q
from loomgraph.session import app_dir
from loomgraph.sources import files, model, schema, sinks
from loomgraph.sources.tables import stream, table
from loomgraph.streaming import watch


GATE = (
    "SELECT * FROM code_file",
    "SELECT ->calls->function AS f FROM function",
    "INSERT INTO code_file VALUES (1)",
    "DELETE function:a",
    "update function set name = 'x'",
    "DEFINE TABLE x",
    "RELATE a->calls->b",
    "SELECT 1; DELETE FROM function",
    "SELECT * FROM function WHERE name = 'DELETE me'",
    'SELECT * FROM function WHERE name = "create"',
    "SELECT updated_at, created FROM function",
    "SELECT * FROM function WHERE name = 'open",
    "SELECT 'it\\'s' AS kill",
    "   ",
)


def _faults(spark, folder, name: str) -> DataFrame:
    return schema.fault_counts(table(spark, folder, name), schema.RULES[name]())


def faults_code_file(spark, folder) -> DataFrame:
    return _faults(spark, folder, "code_file")


def faults_symbols(spark, folder) -> DataFrame:
    return _faults(spark, folder, "symbols")


def faults_edges(spark, folder) -> DataFrame:
    return _faults(spark, folder, "edges")


def nodes_jsonl(spark, folder) -> DataFrame:
    """The node lines, read again: what a line holds of its record."""
    lines = sinks.node_lines(model.code_files(spark, folder), model.symbols(spark, folder))
    r = F.from_json("line", files.NODE)
    return lines.select(r.alias("r")).select("r.id", "r.type", "r.name", "r.file_path", "r.line_start", "r.docstring", "r.path", "r.language", "r.size_bytes", "r.last_indexed_at", F.size("r.embedding").cast("long").alias("dimensions"))


def edges_jsonl(spark, folder) -> DataFrame:
    return sinks.edge_lines(model.edges(spark, folder))


def usage_jsonl(spark, folder) -> DataFrame:
    return sinks.usage_lines(model.usage_events(spark, folder))


def gate_verdicts(spark, folder) -> DataFrame:
    """query, verdict: what the lexical check says of queries that read, that write, and that hide it."""
    rows = []
    for q in GATE:
        try:
            gate.check(q)
            rows.append((q, "ok"))
        except LoomError as e:
            rows.append((q, e.name))
    return spark.createDataFrame(rows, "query string, verdict string")


def policy_cases(spark, folder) -> DataFrame:
    """Every tool for every role under rules that allow, deny, do both or neither, by both defaults, and without a policy."""
    tools = ("map_code", "list_symbols", "query_graph", "index_workspace")
    rules = spark.createDataFrame([(1, "reader", ["map_code", "list_symbols"], []), (2, "careful", [], ["query_graph"]), (3, "both", ["map_code", "query_graph"], ["query_graph"]), (4, "reader", [], ["map_code"])], "place int, agent_role string, allow array<string>, deny array<string>")
    calls = spark.createDataFrame([(t, r) for t in tools for r in ("reader", "careful", "both", "stranger", None)], "tool_name string, agent_role string")
    out = [policy.decisions(calls, rules, on, default).withColumn("mode", F.lit(mode)) for mode, on, default in (("deny", True, False), ("allow", True, True), ("off", False, False))]
    return reduce(DataFrame.unionByName, out).select("mode", "tool_name", "agent_role", "allowed")


def edges_unique(spark, folder) -> DataFrame:
    """Each link once, however many edge_ids it was delivered under."""
    return graph.links(model.edge_lines(spark, folder)).groupBy("edge_type").agg(F.count("*").alias("links"))


def tasks_of_ids(spark, folder) -> DataFrame:
    ids = model.symbols(spark, folder).where("kind = 'interface'").select("id")
    return graph.tasks_of_ids(model.edge_lines(spark, folder), ids)


def concerns_removed(spark, folder) -> DataFrame:
    """The concerns links left once those to the most concerned symbol are removed, and how many went."""
    e = model.edges(spark, folder)
    most = e.where("edge_type = 'concerns' and trim(dst) <> ''").groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").first()[0]
    kept, gone = changes.drop_concerns_of(e, most)
    return kept.where("edge_type = 'concerns'").agg(F.count("*").alias("kept")).join(gone)  # one row each


def brief_records(spark, folder) -> DataFrame:
    return listing.project(table(spark, folder, "backlog_item").distinct(), brief=True)


def response_counters(spark, folder) -> DataFrame:
    """Counts of results read from JSON responses."""
    s = model.symbols(spark, folder)
    body = s.groupBy("file_path").agg(F.to_json(F.struct(F.collect_list(F.struct("name")).alias("symbols"))).alias("response"))
    return body.select("file_path", listing.response_counts(F.lit("list_symbols"), F.col("response")).alias("c")).select("file_path", F.col("c.symbols").cast("long").alias("symbols"), F.col("c.results").cast("long").alias("results"))


def backfill_vectors(spark, folder) -> DataFrame:
    """All records with a vector, those without one by the built-in embedder."""
    r = embed.backfill(model.content_vectors(spark, folder).select("id", "content", "embedding"))
    return r.select("id", F.size("embedding").cast("long").alias("dimensions"), vector.is_meaningful(F.col("embedding")).alias("meaningful"))


def stream_usage_windows(spark, folder) -> DataFrame:
    """Calls and tokens per tool and ten minutes, by a stream over the events that runs until they are drained."""
    events = stream(spark, folder, "events").select(F.col("event_type").alias("tool_name"), F.col("ts").cast("timestamp").alias("timestamp"), F.floor("value").cast("long").alias("estimated_tokens"))
    counted = watch.windowed_usage(events, late=None)
    out = f"{app_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/result")

    query = counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/result").select("tool_name", F.col("starts_at").cast("timestamp_ntz").alias("starts_at"), "calls", "tokens")


QUERIES = {
    f.__name__: f
    for f in (
        faults_code_file, faults_symbols, faults_edges, nodes_jsonl, edges_jsonl, usage_jsonl, gate_verdicts, policy_cases, edges_unique, tasks_of_ids, concerns_removed, brief_records, response_counters, backfill_vectors, stream_usage_windows,
    )
}


def _count(name: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{fault}' AS fault, count(*) AS n FROM {name} WHERE NOT coalesce({ok}, false) HAVING count(*) > 0" for fault, ok in rules.items())


_FILLED = lambda c: {f"{c} is empty": f"{c} <> ''"}

_QUOTED = r"""'(\\.|[^'\\])*'|"(\\.|[^"\\])*\""""


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


GATE_SQL = f"""WITH q AS (SELECT unnest([{", ".join(map(_literal, GATE))}]) AS query), b AS (SELECT query, regexp_replace(query, {_literal(_QUOTED)}, ' ', 'g') AS bare FROM q)
  SELECT query, CASE WHEN trim(query) = '' THEN 'QueryEmpty' WHEN regexp_matches(bare, '[''"]') THEN 'QueryInvalid'
    WHEN regexp_matches(bare, {_literal(r"(?i)\b(" + "|".join(gate.WRITE_WORDS) + r")\b")}) THEN 'QueryRejected' ELSE 'ok' END AS verdict FROM b"""

SQL = {
    "faults_code_file": _count("code_file", _FILLED("path") | _FILLED("language") | _FILLED("content_hash") | {"size_bytes below 0": "size_bytes >= 0"}),
    "faults_symbols": _count(
        "symbols",
        _FILLED("name")
        | _FILLED("file_path")
        | {"line_start below 1": "line_start >= 1", "line_end below 1": "line_end >= 1", "token_count below 0": "token_count >= 0", "kind unknown": "kind IN ('function', 'class', 'interface')"}
        | {"embed_type unknown": "embed_type IN ('explicit_code', 'summary_pointer')", "embedding not finite": "embedding IS NULL OR " + Q.FINITE.format("embedding")},
    ),
    "faults_edges": _count("edges", _FILLED("src") | _FILLED("dst") | {"edge_type unknown": "edge_type IN ('calls', 'imports', 'defines', 'inherits_from', 'concerns')"}),
    "nodes_jsonl": f"""WITH {Q.SYM}, {Q.FILE} SELECT id, kind AS type, name, file_path, line_start, docstring, NULL::VARCHAR AS path, NULL::VARCHAR AS language, NULL::BIGINT AS size_bytes, NULL::VARCHAR AS last_indexed_at,
        CASE WHEN {Q.FINITE.format("embedding")} AND len(list_filter(embedding, lambda v: abs(v) > 1.1920929e-7)) > 0 THEN len(embedding) END AS dimensions FROM sym
      UNION ALL SELECT id, 'code_file', NULL, NULL, NULL, NULL, path, language, size_bytes, strftime(last_indexed_at, '%Y-%m-%dT%H:%M:%SZ'), NULL FROM file""",
    "edges_jsonl": f"""WITH {Q.EDGE} SELECT '{{' || concat_ws(',', '"type":' || to_json(edge_type), '"from":' || to_json(src), '"to":' || to_json(dst), '"import_path":' || to_json(import_path), '"linked_by":' || to_json(linked_by),
      '"created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') || '"') || '}}' AS line FROM edge""",
    "usage_jsonl": f"""WITH {Q.EVENT} SELECT branch, '{{' || concat_ws(',', '"tool_name":' || to_json(tool_name), '"timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%g') || '"', '"response_bytes":' || response_bytes, '"estimated_tokens":' || estimated_tokens,
      '"results_returned":' || results_returned, '"branch":' || to_json(branch), '"connection_id":' || to_json(connection_id), '"agent_role":' || to_json(agent_role), '"outcome":' || to_json(outcome)) || '}}' AS line FROM event""",
    "gate_verdicts": GATE_SQL,
    "policy_cases": """WITH t(tool_name) AS (VALUES ('map_code'), ('list_symbols'), ('query_graph'), ('index_workspace')), r(agent_role) AS (VALUES ('reader'), ('careful'), ('both'), ('stranger'), (NULL)), m(mode) AS (VALUES ('deny'), ('allow'), ('off'))
      SELECT mode, tool_name, agent_role, CASE WHEN mode = 'off' THEN true WHEN agent_role = 'reader' THEN tool_name IN ('map_code', 'list_symbols') WHEN agent_role = 'careful' THEN tool_name <> 'query_graph'
        WHEN agent_role = 'both' THEN tool_name = 'map_code' ELSE mode = 'allow' END AS allowed FROM t, r, m""",
    "backfill_vectors": f"""WITH {Q.VECTOR} SELECT id, CASE WHEN len(embedding) > 0 THEN len(embedding) WHEN content IS NULL THEN NULL ELSE 384 END AS dimensions,
      CASE WHEN len(embedding) > 0 THEN len(list_filter(embedding, lambda v: abs(v) > 1.1920929e-7)) > 0 ELSE coalesce(regexp_matches(left(content, 4096), '[\\p{{L}}\\p{{N}}_]'), false) END AS meaningful FROM vrecord""",
    "edges_unique": f"WITH {Q.LINK} SELECT edge_type, count(*) AS links FROM link GROUP BY 1",
    "tasks_of_ids": f"WITH {Q.SYM}, {Q.LINK} SELECT src AS task, dst AS id FROM link WHERE edge_type = 'concerns' AND dst IN (SELECT id FROM sym WHERE kind = 'interface')",
    "concerns_removed": f"""WITH {Q.EDGE}, c AS (SELECT dst FROM edge WHERE edge_type = 'concerns'), m AS (SELECT dst FROM c WHERE trim(dst) <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
      SELECT count(*) FILTER (WHERE dst IS DISTINCT FROM (SELECT dst FROM m)) AS kept, count(*) FILTER (WHERE dst = (SELECT dst FROM m)) AS removed FROM c""",
    "brief_records": "SELECT id, title, status FROM (SELECT DISTINCT * FROM backlog_item)",
    "response_counters": f"WITH {Q.SYM} SELECT file_path, count(*) AS symbols, count(*) AS results FROM sym GROUP BY 1",
    "stream_usage_windows": "SELECT event_type AS tool_name, time_bucket(INTERVAL 10 MINUTE, ts) AS starts_at, count(*) AS calls, sum(floor(value)::BIGINT)::BIGINT AS tokens FROM events GROUP BY ALL",
}
