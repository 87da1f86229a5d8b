"""Queries of telemetry, policy, calibration, change detection, commits and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text, vector
from loomgraph.operators import calibration, changes, commits, extract, graph, policy, telemetry
from loomgraph.plans import sqlparts as Q
from loomgraph.sources import model
from loomgraph.sources.files import MAX_FILE_BYTES
from loomgraph.sources.tables import table
from loomgraph.streaming import watch

SINCE, UNTIL = "2024-06-01T00:00:00Z", "2025-03-01T00:00:00Z"
HAMMER_DAYS = 30
RULES = [(1, "role_1", ["view", "click"], []), (2, "role_2", [], ["error"]), (3, "role_3", ["view"], ["view"]), (4, "role_1", [], ["view"])]


def usage_summary_by_tool(spark, folder) -> DataFrame:
    return telemetry.by_tool(model.usage_events(spark, folder))


def usage_totals(spark, folder) -> DataFrame:
    return telemetry.totals(model.usage_events(spark, folder))


def usage_top_tools(spark, folder) -> DataFrame:
    return telemetry.top_tools(model.usage_events(spark, folder))


def branch_compare(spark, folder) -> DataFrame:
    return telemetry.compare_branches(model.usage_events(spark, folder), "main", "feature__x")


def token_report(spark, folder) -> DataFrame:
    return telemetry.token_report(model.usage_events(spark, folder))


def agent_efficiency(spark, folder) -> DataFrame:
    a = telemetry.efficiency(model.usage_events(spark, folder))
    return a.select("*", F.round(telemetry.agent_score(), 6).alias("score")).withColumns({c: F.round(c, 6) for c in ("avg_tokens_per_call", "tokens_per_result", "error_rate")})


def efficiency_score(spark, folder) -> DataFrame:
    return telemetry.overall_score(telemetry.efficiency(model.usage_events(spark, folder)))


def anomalies(spark, folder) -> DataFrame:
    e = model.usage_events(spark, folder)
    return telemetry.anomalies(telemetry.efficiency(e), telemetry.hammering(e))


def recommendations(spark, folder) -> DataFrame:
    e = model.usage_events(spark, folder)
    a = telemetry.efficiency(e)
    return telemetry.recommendations(a, telemetry.anomalies(a, telemetry.hammering(e)))


def tool_hammering(spark, folder) -> DataFrame:
    return telemetry.hammering(model.usage_events(spark, folder))


def tool_hammering_month(spark, folder) -> DataFrame:
    """The same within HAMMER_DAYS days: the events of the tables are too far apart for a minute."""
    return telemetry.hammering(model.usage_events(spark, folder), HAMMER_DAYS * 86_400)


def latency_percentiles(spark, folder) -> DataFrame:
    return telemetry.latency_percentiles(model.usage_events(spark, folder))


def query_timing_p95(spark, folder) -> DataFrame:
    return telemetry.query_timing(model.usage_events(spark, folder))


def recent_events_ring(spark, folder) -> DataFrame:
    return telemetry.recent(model.usage_events(spark, folder)).select("event_id", "tool_name", "timestamp")


def rolling_samples(spark, folder) -> DataFrame:
    return telemetry.recent_samples(model.usage_events(spark, folder)).select("event_id", "tool_name", "elapsed_ms")


def rolling_rate(spark, folder) -> DataFrame:
    return telemetry.rolling_rate(model.usage_events(spark, folder), 3600)


def rate_limited(spark, folder) -> DataFrame:
    return telemetry.rate_limited(model.usage_events(spark, folder), 2, 7200)


def policy_decisions(spark, folder) -> DataFrame:
    rules = spark.createDataFrame(RULES, "place int, agent_role string, allow array<string>, deny array<string>")
    e = model.usage_events(spark, folder)
    params = F.to_json(F.struct(F.struct("agent_role").alias("_meta")))
    calls = e.select("event_id", "tool_name", policy.role_of(params).alias("agent_role"))
    return policy.decisions(calls, rules, unmatched_allowed=False)


def _turns(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Documents as the turns of one session per source."""
    d = table(spark, folder, "documents").where("source is not null")
    sessions = d.select(F.col("source").alias("session_id"), F.substring_index("source", "/", 1).alias("repository"), F.col("source").alias("branch")).distinct()
    return sessions, d.select(F.col("source").alias("session_id"), F.col("doc_id").alias("turn_index"), F.col("ingested_at").alias("timestamp"), F.col("text").alias("assistant_response"))


def session_join(spark, folder) -> DataFrame:
    sessions, turns = _turns(spark, folder)
    return calibration.baseline_records(sessions, turns).select("session_id", "turn_index", "branch", F.size("tools").cast("long").alias("calls"), "estimated_tokens", "purpose")


def purpose_calibration(spark, folder) -> DataFrame:
    sessions, turns = _turns(spark, folder)
    e = model.usage_events(spark, folder)
    named = F.create_map(*[F.lit(x) for kv in TOOLS.items() for x in kv])[F.col("tool_name")]
    calls = e.select(calibration.purpose_of(named, F.col("results_returned")).alias("purpose"), "estimated_tokens")
    return calibration.report(calibration.baseline_records(sessions, turns), calls)


TOOLS = {"view": "list_symbols", "click": "map_code", "signup": "impact_analysis", "purchase": "unified_search", "error": "query_memory"}


def codebase_context(spark, folder) -> DataFrame:
    files = table(spark, folder, "source_file").where("source is not null").groupBy("path").agg(F.max("source").alias("source"))
    return calibration.codebase(files.select(text.language_of(F.col("path")).alias("language"), F.size(F.split("source", "\n")).cast("long").alias("lines")))


def _stored(spark, folder) -> DataFrame:
    f = model.code_files(spark, folder)
    return f.select(F.col("path").alias("file_path"), "content_hash", "size_bytes")


def _disk(spark, folder) -> DataFrame:
    s = table(spark, folder, "source_file").where("source is not null and path is not null").groupBy("path").agg(F.max("source").alias("source"))
    return s.select(F.col("path").alias("file_path"), F.sha2("source", 256).alias("content_hash"), F.octet_length("source").cast("long").alias("size_bytes"))


def change_detection(spark, folder) -> DataFrame:
    return changes.classify(_stored(spark, folder), _disk(spark, folder))


def change_counts(spark, folder) -> DataFrame:
    return changes.change_counts(change_detection(spark, folder))


def deleted_files(spark, folder) -> DataFrame:
    return changes.missing(_stored(spark, folder), _disk(spark, folder), "file_path").select("file_path")


def sync_states(spark, folder) -> DataFrame:
    disk = _disk(spark, folder).select(F.col("file_path").alias("path"), text.language_of(F.col("file_path")).alias("language"), "size_bytes", "content_hash")
    return changes.sync_states(disk, _stored(spark, folder).select(F.col("file_path").alias("path"), "content_hash"), ("rust", "python"), MAX_FILE_BYTES)


def carry_forward(spark, folder) -> DataFrame:
    s = model.symbols(spark, folder)
    new = s.where("deleted_at is null").select("id", "name", "body_hash", F.lit(None).cast("array<float>").alias("embedding"))
    return changes.carry_vectors(new, s.where("deleted_at is not null")).select("id", "reused")


def relink_concerns(spark, folder) -> DataFrame:
    s = model.symbols(spark, folder)
    c = graph.links(model.edge_lines(spark, folder), ("concerns",)).select(F.col("src").alias("task"), F.col("dst").alias("id"))
    old = s.where("deleted_at is not null").select("id", "name", "body_hash", "file_path", "kind")
    return changes.relink(c.join(old, "id"), s.where("deleted_at is null"))


def symbols_by_name_hash(spark, folder) -> DataFrame:
    return changes.same_identity(model.symbols(spark, folder))


def upsert_symbols(spark, folder) -> DataFrame:
    """The symbols table replayed as a merge: early rows are the base, late ones the updates."""
    raw = table(spark, folder, "symbols").select("id", "name", "file_path", F.coalesce("loaded_at", F.lit("1970-01-01").cast("timestamp_ntz")).alias("version"))
    split = F.lit("2025-03-01").cast("timestamp_ntz")
    base = changes.first_of(raw.where(F.col("version") < split).withColumn("o", -F.unix_micros(F.col("version").cast("timestamp"))), ["id"], "o").drop("o")
    return changes.upsert(base, raw.where(F.col("version") >= split), "id")


def dangling_edges(spark, folder) -> DataFrame:
    e = model.edges(spark, folder)
    kept = changes.drop_dangling(e, model.nodes(spark, folder))
    return kept.groupBy("edge_type").agg(F.count("*").alias("kept"))


def gc_vectors(spark, folder) -> DataFrame:
    _, n = changes.drop_corrupt_vectors(model.symbols(spark, folder))
    return n


def finite_check(spark, folder) -> DataFrame:
    e = F.col("embedding")
    return model.symbols(spark, folder).where("embedding is not null").select("id", vector.is_finite(e).alias("finite"), F.when(vector.is_finite(e), vector.is_meaningful(e)).alias("meaningful"))


def commits_by_file(spark, folder) -> DataFrame:
    c = model.commits(spark, folder)
    path = c.select(F.explode("changes").alias("c")).groupBy("c.file_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_path").first()[0]
    return commits.touching(c, path).select("hash", "committed_at", "author_name")


def commits_by_range(spark, folder) -> DataFrame:
    return commits.newest(commits.in_range(model.commits(spark, folder), SINCE, UNTIL), 20).select("hash", "short_hash", "committed_at", "message")


def latest_commit(spark, folder) -> DataFrame:
    return commits.latest_hash(model.commits(spark, folder))


def commit_change_totals(spark, folder) -> DataFrame:
    return commits.change_totals(model.commits(spark, folder))


def commit_changes_by_type(spark, folder) -> DataFrame:
    return commits.changes_by_type(model.commits(spark, folder))


def commits_of_symbols(spark, folder) -> DataFrame:
    return commits.of_symbols(model.symbols(spark, folder), model.commits(spark, folder))


def commits_after_watermark(spark, folder) -> DataFrame:
    c = model.commits(spark, folder)
    return commits.after_watermark(c, commits.in_range(c, None, UNTIL)).select("hash", "committed_at")


def commit_patches(spark, folder) -> DataFrame:
    c = model.commits(spark, folder).select("hash", F.posexplode("changes").alias("place", "c"))
    return c.select("hash", "place", commits.patch(F.coalesce("c.diff_snippet", F.lit(""))).alias("p")).select("hash", "place", "p.snippet", F.col("p.lines_added").cast("long").alias("lines_added"), F.col("p.lines_removed").cast("long").alias("lines_removed"))


def tier_classification(spark, folder) -> DataFrame:
    f = table(spark, folder, "extracted_function").select("fn_id", "signature", "docstring", "body").distinct()
    t = text.tier(F.col("body"), text.token_count(F.col("body")), F.col("signature"), F.col("docstring"))
    return f.select("fn_id", text.token_count(F.col("body")).alias("tokens"), t.alias("t")).select("fn_id", "tokens", "t.embed_type", F.sha2("t.summary", 256).alias("summary_hash"))


def body_slices(spark, folder) -> DataFrame:
    """Bodies taken anew from the sources by their lines, against those that were stored."""
    s = table(spark, folder, "source_file").where("source is not null").groupBy("path").agg(F.max("source").alias("source"))
    f = table(spark, folder, "extracted_function").select("fn_id", F.col("file_path").alias("path"), "line_start", "line_end", "body").distinct()
    again = text.body_lines(F.col("source"), F.col("line_start"), F.col("line_end"))
    return f.join(s, "path").select("fn_id", (F.ltrim(F.translate(again, "\t", " ")) == F.translate("body", "\t", " ")).alias("same"))


def path_filters(spark, folder) -> DataFrame:
    p = F.col("path")
    return model.code_files(spark, folder).select(
        "id", text.is_excluded(p).alias("excluded"), text.is_excluded(p, anywhere=False).alias("excluded_at_root"), text.matches_glob(p, "crates/*/src/**/*.{rs,py}").alias("globbed"), text.matches_glob(p, "*_test.rs", or_name=True).alias("named")
    )


def edit_bursts(spark, folder) -> DataFrame:
    """Events of a user no more than half an hour apart, as one burst."""
    return watch.bursts(model.usage_events(spark, folder), "30 minutes", key="connection_id")


def sync_bursts(spark, folder) -> DataFrame:
    """All events as one watcher's, parted by pauses of more than two seconds."""
    return watch.bursts(model.usage_events(spark, folder))


def debounced_edits(spark, folder) -> DataFrame:
    """Events as edits of one path per user: bursts of half an hour, as their last event's kind."""
    e = model.usage_events(spark, folder).select(F.col("connection_id").alias("path"), F.col("tool_name").alias("kind"), "timestamp")
    return watch.debounced(e, "30 minutes")


def parse_symbols(spark, folder) -> DataFrame:
    return extract.symbols_of(table(spark, folder, "source_file")).drop("body")


def parse_edges(spark, folder) -> DataFrame:
    return extract.edges_of(table(spark, folder, "source_file"))


# Two files whose calls and implementations resolve within each: no callee of the tables is defined in its own file.
PLANTED = {
    "lib.rs": "use crate::base;\npub fn run(n: u32) -> u32 {\n    let x = load(n);\n    store(x)\n}\nfn load(n: u32) -> u32 {\n    n + 1\n}\nfn store(n: u32) -> u32 {\n    load(n) + elsewhere(n)\n}\n",
    "two.rs": "fn load() -> u32 { near() }\nfn near() -> u32 { 1 }\n",
    "shapes.rs": "pub trait Area {\n    fn area(&self) -> f64;\n}\npub struct Circle { r: f64 }\npub struct Square { s: f64 }\nimpl Area for Circle {\n    fn area(&self) -> f64 { self.r }\n}\nimpl Area for Square {\n    fn area(&self) -> f64 { self.s }\n}\nimpl Display for Square {\n    fn fmt(&self) {}\n}\n",
}


def _parsed(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges of all sources, and of the planted ones."""
    planted = spark.createDataFrame(list(PLANTED.items()), "path string, source string")
    files = table(spark, folder, "source_file").select("path", "source").unionByName(planted)
    s = extract.symbols_of(files).select(F.col("path").alias("file_path"), "kind", "name", "line_start", F.concat_ws(":", "path", "name", "line_start").alias("id"))
    return s, extract.edges_of(files).withColumnRenamed("path", "file_path")


def resolve_calls(spark, folder) -> DataFrame:
    """Calls of the parsed sources resolved to functions of the same file."""
    s, e = _parsed(spark, folder)
    return changes.link_calls(e.where("edge_type = 'calls'").select("file_path", F.col("src").alias("caller"), F.col("dst").alias("callee")), s)


def resolve_impls(spark, folder) -> DataFrame:
    """Implementations of the parsed sources resolved to structs and traits of the same file."""
    s, e = _parsed(spark, folder)
    return changes.link_impls(e.where("edge_type = 'inherits_from'").select("file_path", F.col("src").alias("struct"), F.col("dst").alias("trait")), s)


QUERIES = {
    f.__name__: f
    for f in (
        usage_summary_by_tool, usage_totals, usage_top_tools, branch_compare, token_report, agent_efficiency, efficiency_score, anomalies, recommendations, tool_hammering, tool_hammering_month,
        latency_percentiles, query_timing_p95, recent_events_ring, rolling_samples, rolling_rate, rate_limited, policy_decisions, session_join, purpose_calibration, codebase_context,
        change_detection, change_counts, deleted_files, sync_states, carry_forward, relink_concerns, symbols_by_name_hash, upsert_symbols, dangling_edges, gc_vectors, finite_check,
        commits_by_file, commits_by_range, latest_commit, commit_change_totals, commit_changes_by_type, commits_of_symbols, commits_after_watermark, commit_patches,
        tier_classification, body_slices, path_filters, edit_bursts, sync_bursts, debounced_edits, parse_symbols, parse_edges, resolve_calls, resolve_impls,
    )
}

_AGENT = f"""WITH {Q.EVENT}, agent AS (
  SELECT coalesce(agent_role, 'anonymous') AS agent_role, count(*) AS total_calls, sum(estimated_tokens)::BIGINT AS total_tokens, sum(results_returned)::BIGINT AS total_results,
    sum(estimated_tokens)::DOUBLE / count(*) AS avg_tokens_per_call, CASE WHEN sum(results_returned) = 0 THEN 0.0 ELSE sum(estimated_tokens)::DOUBLE / sum(results_returned)::DOUBLE END AS tokens_per_result,
    count(*) FILTER (WHERE outcome <> 'success')::DOUBLE / count(*) AS error_rate, count(DISTINCT tool_name) AS tool_diversity
  FROM event GROUP BY 1),
scored AS (SELECT *, 0.4::DOUBLE * (1.0 - least(tokens_per_result / 1000.0, 1.0)) + 0.3::DOUBLE * (1.0 - error_rate) + 0.15::DOUBLE * least(tool_diversity / 2.0, 1.0) + 0.15::DOUBLE AS score FROM agent),
gaps AS (SELECT coalesce(agent_role, 'anonymous') AS agent_role, tool_name, floor(epoch(timestamp)) - lag(floor(epoch(timestamp)), 20) OVER (PARTITION BY coalesce(agent_role, 'anonymous'), tool_name ORDER BY floor(epoch(timestamp))) AS span FROM event),
hammer AS (SELECT agent_role, min(tool_name) AS tool_name FROM gaps WHERE span <= 60 GROUP BY 1),
odd AS (SELECT 'token_ratio_spike' AS anomaly_type, 'warning' AS severity, agent_role, printf('Agent ''%s'' tokens-per-result %.1f exceeds threshold 10.0', agent_role, tokens_per_result) AS description FROM agent WHERE tokens_per_result > 10.0
  UNION ALL SELECT 'error_burst', 'critical', agent_role, printf('Agent ''%s'' error rate %.0f%% exceeds threshold 30%%', agent_role, error_rate * 100) FROM agent WHERE error_rate > 0.3::DOUBLE
  UNION ALL SELECT 'tool_hammering', 'warning', agent_role, printf('Agent ''%s'' called ''%s'' 21 times within 60 seconds', agent_role, tool_name) FROM hammer)
"""
_DISK = "disk AS (SELECT path, sha256(max(source)) AS content_hash, strlen(max(source)) AS size_bytes FROM source_file WHERE source IS NOT NULL AND path IS NOT NULL GROUP BY 1)"
_CHANGE = f"""WITH {Q.FILE}, {_DISK}, change AS (SELECT coalesce(f.path, d.path) AS path,
  CASE WHEN f.size_bytes IS NULL AND f.content_hash IS NULL THEN 'added' WHEN d.path IS NULL THEN 'deleted'
    WHEN f.size_bytes IS DISTINCT FROM d.size_bytes OR f.content_hash IS DISTINCT FROM d.content_hash THEN 'modified' END AS kind,
  f.content_hash AS previous_hash, d.content_hash AS current_hash FROM file f FULL JOIN disk d ON f.path = d.path)"""
_EXT = "coalesce(map {{'rs': 'rust', 'py': 'python', 'js': 'javascript', 'ts': 'typescript'}}[regexp_extract({0}, '[^.]*$')], regexp_extract({0}, '[^.]*$'))"
_NAMED = "regexp_extract_all(text, '(?i)\\b(?:functions\\.)?(rg|glob|view)\\b', 1)"
_BASE = f"""turn AS (SELECT source AS session_id, doc_id AS turn_index, replace(source, '/', '__') AS branch, {_NAMED} AS tools, greatest(ceil(length(text) / 12.0), 1)::BIGINT AS each FROM documents WHERE source IS NOT NULL),
base AS (SELECT session_id, turn_index, branch, len(tools) AS calls, each * len(tools) AS estimated_tokens, CASE WHEN list_contains(list_transform(tools, lambda t: lower(t)), 'view') THEN 'neighborhood'
  WHEN list_contains(list_transform(tools, lambda t: lower(t)), 'glob') THEN 'broad_exploration' WHEN len(tools) >= 3 THEN 'impact_trace' ELSE 'point_lookup' END AS purpose FROM turn WHERE len(tools) > 0)"""
_OLD = "old AS (SELECT * FROM sym WHERE deleted_at IS NOT NULL), new AS (SELECT * FROM sym WHERE deleted_at IS NULL)"
_C = "c AS (SELECT hash, unnest(changes, recursive := true) FROM commits)"

SQL = {
    "usage_summary_by_tool": f"WITH {Q.EVENT} SELECT tool_name, count(*) AS call_count, sum(estimated_tokens)::BIGINT AS total_tokens, round(sum(estimated_tokens)::DOUBLE / count(*), 2) AS avg_tokens FROM event GROUP BY 1",
    "usage_totals": f"WITH {Q.EVENT} SELECT count(*) AS total_tool_calls, sum(estimated_tokens)::BIGINT AS total_tokens, min(timestamp) AS first_at, max(timestamp) AS last_at, count(DISTINCT connection_id) AS session_count FROM event",
    "usage_top_tools": f"WITH {Q.EVENT} SELECT tool_name, count(*) AS count FROM event GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "branch_compare": f"""WITH {Q.EVENT}, s AS (SELECT count(*) FILTER (WHERE branch = 'main') AS calls, coalesce(sum(estimated_tokens) FILTER (WHERE branch = 'main'), 0)::BIGINT AS tokens,
      count(*) FILTER (WHERE branch = 'feature__x') AS other_calls, coalesce(sum(estimated_tokens) FILTER (WHERE branch = 'feature__x'), 0)::BIGINT AS other_tokens FROM event)
      SELECT *, greatest(calls - other_calls, 0) AS delta_calls, greatest(tokens - other_tokens, 0) AS delta_tokens FROM s""",
    "token_report": f"""WITH {Q.EVENT}, per AS (SELECT branch, tool_name, count(*) AS n, sum(estimated_tokens)::BIGINT AS t FROM event GROUP BY ALL),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY n DESC, tool_name) AS r FROM per)
      SELECT branch, 'Calls: ' || sum(n) || '; tokens: ' || sum(t) || '; per call: ' || printf('%.2f', round(sum(t)::DOUBLE / sum(n), 2)) || '; top: '
        || string_agg(tool_name || ' (' || n || ')', ', ' ORDER BY r) FILTER (WHERE r <= 5) AS report FROM ranked GROUP BY branch""",
    "agent_efficiency": _AGENT + "SELECT agent_role, total_calls, total_tokens, total_results, round(avg_tokens_per_call, 6) AS avg_tokens_per_call, round(tokens_per_result, 6) AS tokens_per_result, round(error_rate, 6) AS error_rate, tool_diversity, round(score, 6) AS score FROM scored",
    "efficiency_score": _AGENT + "SELECT least(greatest(round(100 * sum(score * total_calls) / sum(total_calls)), 0), 100)::INTEGER AS efficiency_score FROM scored",
    "anomalies": _AGENT + "SELECT * FROM odd",
    "recommendations": _AGENT + """SELECT 'use_more_tools' AS kind, agent_role FROM agent WHERE tool_diversity < 2 UNION ALL
      SELECT DISTINCT CASE anomaly_type WHEN 'token_ratio_spike' THEN 'use_targeted_lookups' ELSE 'cache_results' END, NULL::VARCHAR FROM odd WHERE anomaly_type <> 'error_burst'""",
    "tool_hammering": _AGENT + "SELECT * FROM hammer",
    "tool_hammering_month": _AGENT + f"SELECT agent_role, min(tool_name) AS tool_name FROM gaps WHERE span <= {HAMMER_DAYS * 86_400} GROUP BY 1",
    "rate_limited": f"""WITH RECURSIVE {Q.EVENT}, o AS (SELECT event_id, connection_id AS c, epoch_us(timestamp) AS us, row_number() OVER (PARTITION BY connection_id ORDER BY timestamp, event_id) AS k FROM event),
      r AS (SELECT event_id, c, k, true AS accepted, [us] AS held FROM o WHERE k = 1 UNION ALL
        SELECT o.event_id, o.c, o.k, len(kept) < 2, CASE WHEN len(kept) < 2 THEN list_append(kept, o.us) ELSE kept END
        FROM (SELECT c, k + 1 AS k, held FROM r) p JOIN o USING (c, k), LATERAL (SELECT list_filter(p.held, lambda h: h > o.us - 7200000000) AS kept) l)
      SELECT event_id, accepted FROM r""",
    "latency_percentiles": f"""WITH {Q.EVENT}, l AS (SELECT tool_name, list_sort(list(elapsed_ms)) AS v, count(*) AS n FROM event WHERE elapsed_ms IS NOT NULL GROUP BY 1)
      SELECT tool_name, v[least(n * 50 // 100 + 1, n)] AS p50, v[least(n * 95 // 100 + 1, n)] AS p95, v[least(n * 99 // 100 + 1, n)] AS p99 FROM l""",
    "query_timing_p95": f"WITH {Q.EVENT} SELECT tool_name, count(*) AS total, count(*) FILTER (WHERE elapsed_ms >= 100) AS slow_count, round(avg(elapsed_ms), 6) AS avg_ms, quantile_disc(elapsed_ms, 0.95) AS p95_ms FROM event GROUP BY 1",
    "recent_events_ring": f"WITH {Q.EVENT} SELECT event_id, tool_name, timestamp FROM event ORDER BY timestamp DESC, event_id DESC LIMIT 256",
    "rolling_samples": f"WITH {Q.EVENT} SELECT event_id, tool_name, elapsed_ms FROM event QUALIFY row_number() OVER (PARTITION BY tool_name ORDER BY timestamp DESC, event_id DESC) <= 1000",
    "rolling_rate": f"WITH {Q.EVENT} SELECT event_id, count(*) OVER (PARTITION BY connection_id ORDER BY floor(epoch(timestamp))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS calls FROM event",
    "policy_decisions": f"""WITH {Q.EVENT} SELECT event_id, tool_name, agent_role, CASE agent_role WHEN 'role_1' THEN tool_name IN ('view', 'click') WHEN 'role_2' THEN tool_name <> 'error' ELSE false END AS allowed FROM event""",
    "session_join": f"WITH {_BASE} SELECT * FROM base",
    "purpose_calibration": f"""WITH {Q.EVENT}, {_BASE}, call AS (SELECT CASE WHEN tool_name = 'view' THEN 'point_lookup' WHEN tool_name = 'signup' THEN 'impact_trace' WHEN tool_name = 'purchase' THEN 'broad_exploration'
        WHEN tool_name = 'click' AND results_returned <= 1 THEN 'point_lookup' WHEN tool_name = 'click' THEN 'neighborhood' ELSE 'implementation' END AS purpose, estimated_tokens FROM event),
      b AS (SELECT purpose, median(estimated_tokens) AS m, count(*) AS n FROM base GROUP BY 1), t AS (SELECT purpose, median(estimated_tokens) AS m, count(*) AS n FROM call GROUP BY 1)
      SELECT p.purpose, round(coalesce(b.m, 0.0), 2) AS baseline_median, round(coalesce(t.m, 0.0), 2) AS tool_median, round(CASE WHEN coalesce(t.m, 0) = 0 THEN 0.0 ELSE coalesce(b.m, 0.0) / t.m END, 2) AS multiplier,
        coalesce(b.n, 0) AS baseline_samples, coalesce(t.n, 0) AS tool_samples, CASE WHEN least(coalesce(b.n, 0), coalesce(t.n, 0)) < 10 THEN 'low' WHEN least(coalesce(b.n, 0), coalesce(t.n, 0)) <= 50 THEN 'medium' ELSE 'high' END AS confidence
      FROM (VALUES ('point_lookup'), ('neighborhood'), ('impact_trace'), ('broad_exploration'), ('implementation')) p(purpose) LEFT JOIN b USING (purpose) LEFT JOIN t USING (purpose)""",
    "codebase_context": f"""WITH f AS (SELECT path, max(source) AS source FROM source_file WHERE source IS NOT NULL GROUP BY 1), l AS (SELECT {_EXT.format('path')} AS language, len(string_split(source, chr(10))) AS lines FROM f),
      g AS (SELECT language, count(*) AS n, sum(lines)::BIGINT AS loc FROM l GROUP BY 1)
      SELECT (SELECT language FROM g ORDER BY n DESC, language DESC LIMIT 1) AS language, sum(n)::BIGINT AS total_files, sum(loc)::BIGINT AS total_loc, CASE WHEN sum(loc) < 10000 THEN 'small' WHEN sum(loc) <= 100000 THEN 'medium' ELSE 'large' END AS size_bracket FROM g""",
    "change_detection": _CHANGE + " SELECT * FROM change WHERE kind IS NOT NULL",
    "change_counts": _CHANGE + " SELECT kind, count(*) AS n FROM change WHERE kind IS NOT NULL GROUP BY 1",
    "deleted_files": f"WITH {Q.FILE}, {_DISK} SELECT path AS file_path FROM file WHERE path NOT IN (SELECT path FROM disk)",
    "sync_states": f"""WITH {Q.FILE}, {_DISK} SELECT d.path, CASE WHEN d.size_bytes = 0 THEN 'empty' WHEN d.size_bytes > 1048576 THEN 'oversized' WHEN {_EXT.format('d.path')} NOT IN ('rust', 'python') THEN 'other_language'
      WHEN f.content_hash = d.content_hash THEN 'unchanged' ELSE 'parse' END AS status FROM disk d LEFT JOIN file f ON f.path = d.path""",
    "carry_forward": f"WITH {Q.SYM}, {_OLD} SELECT id, EXISTS (SELECT 1 FROM old WHERE old.name = new.name AND old.body_hash = new.body_hash AND len(list_filter(old.embedding, lambda v: abs(v) > 1.1920929e-7)) > 0) AS reused FROM new",
    "relink_concerns": f"""WITH {Q.SYM}, {Q.LINK}, {_OLD}, a AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY name, body_hash ORDER BY file_path, id) = 1), b AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY name, file_path, kind ORDER BY line_start, id) = 1)
      SELECT l.src AS task, o.id AS old_id, coalesce(a.id, b.id) AS new_id, CASE WHEN a.id IS NOT NULL THEN 'identity' WHEN b.id IS NOT NULL THEN 'name' ELSE 'orphaned' END AS how
      FROM link l JOIN old o ON o.id = l.dst LEFT JOIN a ON a.name = o.name AND a.body_hash = o.body_hash LEFT JOIN b ON b.name = o.name AND b.file_path = o.file_path AND b.kind = o.kind WHERE l.edge_type = 'concerns'""",
    "symbols_by_name_hash": f"WITH {Q.SYM} SELECT name, body_hash, count(*) AS n FROM sym GROUP BY ALL HAVING count(*) > 1",
    "upsert_symbols": "SELECT id, name, file_path, coalesce(loaded_at, TIMESTAMP '1970-01-01') AS version FROM symbols QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(loaded_at, TIMESTAMP '1970-01-01') DESC) = 1",
    "dangling_edges": f"WITH {Q.NODE}, {Q.EDGE} SELECT edge_type, count(*) AS kept FROM edge WHERE src IN (SELECT id FROM node) AND dst IN (SELECT id FROM node) GROUP BY 1",
    "gc_vectors": f"WITH {Q.SYM} SELECT count(*) FILTER (WHERE len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) > 0) AS removed FROM sym",
    "finite_check": f"""WITH {Q.SYM}, f AS (SELECT id, embedding, len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AS finite FROM sym WHERE embedding IS NOT NULL)
      SELECT id, finite, CASE WHEN finite THEN len(list_filter(embedding, lambda v: abs(v) > 1.1920929e-7)) > 0 END AS meaningful FROM f""",
    "commits_by_file": f"WITH {Q.COMMIT}, {_C}, top AS (SELECT file_path FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT hash, committed_at, author_name FROM commits, top WHERE len(list_filter(changes, lambda x: x.file_path = top.file_path)) > 0",
    "commits_by_range": f"WITH {Q.COMMIT} SELECT hash, short_hash, committed_at, message FROM commits WHERE committed_at BETWEEN TIMESTAMP '2024-06-01' AND TIMESTAMP '2025-03-01' ORDER BY committed_at DESC, hash LIMIT 20",
    "latest_commit": f"WITH {Q.COMMIT} SELECT hash FROM commits ORDER BY committed_at DESC, hash DESC LIMIT 1",
    "commit_change_totals": f"WITH {Q.COMMIT}, {_C} SELECT (SELECT count(*) FROM commits) AS commits, count(*) AS changes, sum(lines_added)::BIGINT AS lines_added, sum(lines_removed)::BIGINT AS lines_removed FROM c",
    "commit_changes_by_type": f"WITH {Q.COMMIT}, {_C} SELECT change_type, count(*) AS n, count(DISTINCT file_path) AS files, sum(lines_added)::BIGINT AS lines_added, sum(lines_removed)::BIGINT AS lines_removed FROM c GROUP BY 1",
    "commits_of_symbols": f"WITH {Q.SYM}, {Q.COMMIT}, {_C} SELECT sym.id, hash, committed_at FROM sym JOIN (SELECT DISTINCT hash, file_path FROM c) USING (file_path) JOIN commits USING (hash)",
    "commits_after_watermark": f"WITH {Q.COMMIT} SELECT hash, committed_at FROM commits WHERE committed_at > (SELECT max(committed_at) FROM commits WHERE committed_at <= TIMESTAMP '2025-03-01')",
    "commit_patches": f"""WITH {Q.COMMIT}, c AS (SELECT hash, unnest(range(len(changes)))::INTEGER AS place, unnest(list_transform(changes, lambda x: coalesce(x.diff_snippet, ''))) AS d FROM commits),
      l AS (SELECT *, string_split(d, chr(10)) AS lines FROM c)
      SELECT hash, place, CASE WHEN len(lines) > 500 THEN array_to_string(lines[1:500], chr(10)) || chr(10) || '[diff truncated]' || chr(10) ELSE d END AS snippet,
        len(list_filter(lines[1:500], lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++'))) AS lines_added, len(list_filter(lines[1:500], lambda x: starts_with(x, '-') AND NOT starts_with(x, '---'))) AS lines_removed FROM l""",
    "tier_classification": """WITH f AS (SELECT DISTINCT fn_id, coalesce(signature, '') AS signature, coalesce(docstring, '') AS docstring, body, strlen(body) // 4 AS tokens, left(array_to_string(string_split(coalesce(body, ''), chr(10))[1:5], chr(10)), 256) AS preview FROM extracted_function)
      SELECT fn_id, tokens, CASE WHEN tokens <= 512 THEN 'explicit_code' ELSE 'summary_pointer' END AS embed_type,
        sha256(CASE WHEN tokens <= 512 THEN body WHEN docstring <> '' THEN signature || chr(10) || chr(10) || docstring WHEN preview <> '' THEN signature || chr(10) || chr(10) || preview ELSE signature END) AS summary_hash FROM f""",
    "body_slices": """WITH s AS (SELECT path, max(source) AS source FROM source_file WHERE source IS NOT NULL GROUP BY 1), f AS (SELECT DISTINCT fn_id, file_path AS path, line_start, line_end, body FROM extracted_function),
      b AS (SELECT fn_id, body, array_to_string(string_split(regexp_replace(source, '\\n$', ''), chr(10))[line_start:line_end], chr(10)) AS again FROM f JOIN s USING (path))
      SELECT fn_id, ltrim(replace(again, chr(9), ' ')) = replace(body, chr(9), ' ') AS same FROM b""",
    "path_filters": f"""WITH {Q.FILE} SELECT id, regexp_matches(path, '(^|/)(\\.loomgraph|\\.git|node_modules|target|\\.env)(/|$)') AS excluded, regexp_matches(path, '^(\\.loomgraph|\\.git|node_modules|target|\\.env)(/|$)') AS excluded_at_root,
      regexp_matches(path, '^crates/.*/src/.*[.](rs|py)$') AS globbed, ends_with(path, '_test.rs') AS named FROM file""",
    "sync_bursts": f"""WITH {Q.EVENT}, g AS (SELECT timestamp, coalesce(timestamp - lag(timestamp) OVER (ORDER BY timestamp) > INTERVAL 2 SECOND, true)::INTEGER AS cut FROM event),
      s AS (SELECT *, sum(cut) OVER (ORDER BY timestamp) AS burst FROM g) SELECT count(*) AS events, min(timestamp) AS first_at, max(timestamp) AS last_at FROM s GROUP BY burst""",
    "debounced_edits": f"""WITH {Q.EVENT}, g AS (SELECT *, (timestamp - lag(timestamp) OVER w > INTERVAL 30 MINUTE)::INTEGER AS cut FROM event WINDOW w AS (PARTITION BY connection_id ORDER BY timestamp)),
      s AS (SELECT *, sum(coalesce(cut, 0)) OVER (PARTITION BY connection_id ORDER BY timestamp) AS burst FROM g)
      SELECT connection_id AS path, arg_max(tool_name, timestamp) AS kind, min(timestamp) AS first_at, max(timestamp) AS last_at, count(*) AS events FROM s GROUP BY connection_id, burst""",
    "resolve_calls": "SELECT * FROM (VALUES ('lib.rs:run:2', 'lib.rs:load:6'), ('lib.rs:run:2', 'lib.rs:store:9'), ('lib.rs:store:9', 'lib.rs:load:6'), ('two.rs:load:1', 'two.rs:near:2')) v(src, dst)",
    "resolve_impls": "SELECT * FROM (VALUES ('shapes.rs:Circle:4', 'shapes.rs:Area:1'), ('shapes.rs:Square:5', 'shapes.rs:Area:1')) v(src, dst)",
    "edit_bursts": f"""WITH {Q.EVENT}, g AS (SELECT *, (timestamp - lag(timestamp) OVER w > INTERVAL 30 MINUTE)::INTEGER AS cut FROM event WINDOW w AS (PARTITION BY connection_id ORDER BY timestamp)),
      s AS (SELECT *, sum(coalesce(cut, 0)) OVER (PARTITION BY connection_id ORDER BY timestamp) AS burst FROM g) SELECT connection_id, count(*) AS events, min(timestamp) AS first_at, max(timestamp) AS last_at FROM s GROUP BY connection_id, burst""",
}
