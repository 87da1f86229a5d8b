"""Queries that go through files, streams and single-record changes, and come back as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import text
from loomgraph.operators import changes, graph, search
from loomgraph.plans import sqlparts as Q
from loomgraph.plans.retrieval import busiest
from loomgraph.session import app_dir, stage
from loomgraph.sources import files, model, sinks
from loomgraph.sources.tables import table
from loomgraph.streaming import watch

QUERY_SET = 20
FIRST = 5


def _place(spark) -> str:
    return f"{app_dir(spark)}/files-{uuid.uuid4().hex}"


def nodes_read_back(spark, folder) -> DataFrame:
    """The graph's nodes through nodes.jsonl, written as one file and read again."""
    path = f"{_place(spark)}/nodes.jsonl"
    sinks.write_lines(sinks.node_lines(model.code_files(spark, folder), model.symbols(spark, folder)), path)
    nodes, _ = files.read_nodes(spark, path)
    return nodes.select("id", "type", F.coalesce("name", "path").alias("name"), "line_end", "signature", "token_count", "content_hash")


def edges_read_back(spark, folder) -> DataFrame:
    """The graph's edges through edges.jsonl; those without an end are skipped lines."""
    path = f"{_place(spark)}/edges.jsonl"
    sinks.write_lines(sinks.edge_lines(model.edges(spark, folder)), path)
    edges, bad = files.read_edges(spark, path)
    kept = edges.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("from", "to").alias("links"))
    return kept.unionByName(bad.agg(F.count("*").alias("n")).select(F.lit("skipped").alias("type"), "n", F.lit(0).cast("long").alias("links")))


def usage_read_back(spark, folder) -> DataFrame:
    """Usage events of one branch through its usage file: calls and tokens by tool."""
    path = f"{_place(spark)}/usage.jsonl"
    sinks.write_lines(sinks.usage_lines(model.usage_events(spark, folder)).where("branch = 'main'"), path)
    return files.read_usage(spark, path).groupBy("tool_name", "outcome").agg(F.count("*").alias("calls"), F.sum("estimated_tokens").alias("tokens"))


def _drained(counted: DataFrame, at: str) -> DataFrame:
    counted.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return counted.sparkSession.read.schema(counted.schema).parquet(f"{at}/out")


def stream_debounced(spark, folder) -> DataFrame:
    """Commit changes as a watcher's events, dropped as files and streamed: bursts of half an hour by path, as their last event's kind. An
    event long after all others closes the last bursts, and is in none."""
    c = model.commits(spark, folder).where("committed_at is not null").select("committed_at", F.explode("changes").alias("c"))
    kind = F.when(F.col("c.change_type") == "add", "created").when(F.col("c.change_type") == "delete", "deleted").otherwise("modified")
    e = c.groupBy(F.col("c.file_path").alias("path"), F.col("committed_at").cast("timestamp").alias("timestamp")).agg(F.min(kind).alias("kind"))
    end = e.agg((F.max("timestamp") + F.expr("interval 30 days")).alias("timestamp")).select(F.lit("end").alias("path"), "timestamp", F.lit("created").alias("kind"))
    at = _place(spark)
    e.unionByName(end).select("path", F.lit(None).cast("string").alias("old_path"), "kind", "timestamp").write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{at}/in")
    events = watch.relevant(watch.changes(spark, f"{at}/in", 1_000_000))  # one batch, so that no event is late
    out = _drained(watch.debounced(events, "30 minutes"), at)
    return out.select("path", "kind", F.col("first_at").cast("timestamp_ntz").alias("first_at"), F.col("last_at").cast("timestamp_ntz").alias("last_at"), "events")


def stream_usage_files(spark, folder) -> DataFrame:
    """Usage events written by a stream as lines below a folder per branch, read again."""
    at = _place(spark)
    model.usage_events(spark, folder).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")).drop("elapsed_ms", "event_id").write.json(f"{at}/in")
    watch.write_usage(watch.usage(spark, f"{at}/in"), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    back = spark.read.schema(T.StructType([*files.USAGE.fields, T.StructField("branch_dir", T.StringType())])).json(f"{at}/out")
    return back.groupBy("branch_dir", "tool_name").agg(F.count("*").alias("calls"), F.sum("response_bytes").alias("bytes"))


def file_cleared(spark, folder) -> DataFrame:
    """What is left of symbols and links once the file of the most symbols is cleared."""
    s, e = model.symbols(spark, folder), graph.links(model.edge_lines(spark, folder))
    path = s.groupBy("file_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_path").first()[0]
    left, links = changes.clear_file(s, e, path)
    return left.agg(F.count("*").alias("symbols")).join(links.agg(F.count("*").alias("links")))  # one row each


def task_unlinked(spark, folder) -> DataFrame:
    """A task's concerns links to one name removed: how many stay, how many go."""
    s, e = model.symbols(spark, folder), graph.links(model.edge_lines(spark, folder), ("concerns",))
    most = e.join(s.select(F.col("id").alias("dst"), "name"), "dst").groupBy("src", "name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src", "name").first()
    stay, gone = changes.unlink(e, s, most.src, most.name)
    return stay.agg(F.count("*").alias("kept")).join(gone.agg(F.count("*").alias("removed")))  # one row each


def vectors_replaced(spark, folder) -> DataFrame:
    """Interfaces with a new vector, all others with theirs."""
    s = model.symbols(spark, folder)
    new = s.where("kind = 'interface'").select("id", F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float")).alias("embedding"))
    return changes.with_vectors(s, new).select("id", F.size("embedding").cast("long").alias("dimensions"))


def link_exists(spark, folder) -> DataFrame:
    """Is there a call from the busiest caller to itself, and one that is there?"""
    e = model.edge_lines(spark, folder)
    root = busiest(model.symbols(spark, folder), e, "src")
    other = graph.outbound(e, root).where("edge_type = 'calls'").orderBy("dst").first().dst
    return graph.link_exists(e, "calls", root, root).withColumn("which", F.lit("self")).unionByName(graph.link_exists(e, "calls", root, other).withColumn("which", F.lit("other")))


def bfs_calls_only(spark, folder) -> DataFrame:
    """The neighbourhood along calls alone."""
    n, e = model.nodes(spark, folder), model.edge_lines(spark, folder)
    out, _ = graph.neighbourhood(n, e, busiest(model.symbols(spark, folder), e, "dst"), 2, None, ("calls",))
    return out.select("id", "depth")


def relevance_precision(spark, folder) -> DataFrame:
    """A set of QUERY_SET title lines as queries, each record's own expected: how often keyword search has it among the first five of all
    adr records."""
    r = model.content_records(spark, folder).where("content_type = 'adr' and content is not null")
    title = F.regexp_extract("content", "^#* *([^\\n]+)", 1)
    asked = [tuple(x) for x in r.select("id", title.alias("title")).where("trim(title) <> ''").orderBy("id").limit(QUERY_SET).collect()]
    queries = stage(spark.createDataFrame(asked, "query string, title string"), "queries")
    each = r.select("id", "content", F.explode(F.array(*[F.struct(F.lit(q).alias("query"), F.lit(t).alias("title")) for q, t in asked])).alias("q")) if asked else r.select("id", "content", F.struct(F.lit("").alias("query"), F.lit("").alias("title")).alias("q")).limit(0)
    scored = each.select("q.query", "id", F.round(text.keyword_score(F.col("q.title"), F.col("content")), search.DIGITS).alias("score"))
    ranked = scored.withColumn("rank", F.expr("row_number() over (partition by query order by score desc, id)"))
    return search.precision_at(ranked.where(F.col("rank") <= FIRST).select("query", "id", "rank"), queries.select("query", F.col("query").alias("id")))


QUERIES = {
    f.__name__: f
    for f in (
        nodes_read_back, edges_read_back, usage_read_back, stream_debounced, stream_usage_files, file_cleared, task_unlinked, vectors_replaced, link_exists, bfs_calls_only, relevance_precision,
    )
}

SQL = {
    "nodes_read_back": f"WITH {Q.SYM}, {Q.FILE} SELECT id, kind AS type, name, line_end, signature, token_count, NULL::VARCHAR AS content_hash FROM sym UNION ALL SELECT id, 'code_file', path, NULL, NULL, NULL, content_hash FROM file",
    "edges_read_back": f"""WITH {Q.EDGE} SELECT edge_type AS type, count(*) AS n, count(DISTINCT (src, dst)) AS links FROM edge WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1
      UNION ALL SELECT 'skipped', count(*) FILTER (WHERE src IS NULL OR dst IS NULL), 0 FROM edge""",
    "usage_read_back": f"WITH {Q.EVENT} SELECT tool_name, outcome, count(*) AS calls, sum(estimated_tokens)::BIGINT AS tokens FROM event WHERE branch = 'main' GROUP BY 1, 2",
    "stream_debounced": f"""WITH {Q.COMMIT}, c AS (SELECT committed_at, unnest(changes, recursive := true) FROM commits WHERE committed_at IS NOT NULL),
      e AS (SELECT file_path AS path, committed_at AS timestamp, min(CASE change_type WHEN 'add' THEN 'created' WHEN 'delete' THEN 'deleted' ELSE 'modified' END) AS kind FROM c
        WHERE NOT regexp_matches(file_path, '(^|/)(\\.loomgraph|\\.git|node_modules|target|\\.env)(/|$)') GROUP BY 1, 2),
      g AS (SELECT *, (timestamp - lag(timestamp) OVER w > INTERVAL 30 MINUTE)::INTEGER AS cut FROM e WINDOW w AS (PARTITION BY path ORDER BY timestamp)),
      s AS (SELECT *, sum(coalesce(cut, 0)) OVER (PARTITION BY path ORDER BY timestamp) AS burst FROM g)
      SELECT path, arg_max(kind, timestamp) AS kind, min(timestamp) AS first_at, max(timestamp) AS last_at, count(*) AS events FROM s GROUP BY path, burst""",
    "stream_usage_files": f"WITH {Q.EVENT} SELECT replace(branch, '/', '__') AS branch_dir, tool_name, count(*) AS calls, sum(response_bytes)::BIGINT AS bytes FROM event GROUP BY 1, 2",
    "file_cleared": f"""WITH {Q.SYM}, {Q.LINK}, f AS (SELECT file_path FROM sym GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), g AS (SELECT id FROM sym WHERE file_path = (SELECT file_path FROM f))
      SELECT (SELECT count(*) FROM sym WHERE file_path <> (SELECT file_path FROM f)) AS symbols, count(*) AS links FROM link WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g)""",
    "task_unlinked": f"""WITH {Q.SYM}, {Q.LINK}, c AS (SELECT src, dst, name FROM link LEFT JOIN sym ON sym.id = dst WHERE edge_type = 'concerns'),
      m AS (SELECT src, name FROM c WHERE name IS NOT NULL GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 1)
      SELECT count(*) FILTER (WHERE NOT coalesce(c.src = m.src AND c.name = m.name, false)) AS kept, count(*) FILTER (WHERE c.src = m.src AND c.name = m.name) AS removed FROM c, m""",
    "vectors_replaced": f"WITH {Q.SYM} SELECT id, CASE WHEN kind = 'interface' THEN 2 ELSE len(embedding) END AS dimensions FROM sym",
    "link_exists": f"""WITH {Q.SYM}, {Q.LINK}, r AS (SELECT src FROM link WHERE edge_type = 'calls' AND src IN (SELECT id FROM sym) GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)
      SELECT 'self' AS which, count(*) > 0 AS there FROM link, r WHERE edge_type = 'calls' AND link.src = r.src AND dst = r.src UNION ALL SELECT 'other', count(*) > 0 FROM link, r WHERE edge_type = 'calls' AND link.src = r.src""",
    "bfs_calls_only": f"""WITH RECURSIVE {Q.NODE}, {Q.LINK}, root AS (SELECT dst AS id FROM link WHERE edge_type = 'calls' AND dst IN (SELECT id FROM sym) GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1),
      way AS (SELECT src AS a, dst AS b FROM link WHERE edge_type = 'calls' UNION SELECT dst, src FROM link WHERE edge_type = 'calls'),
      one AS (SELECT DISTINCT b AS id FROM way, root WHERE a = root.id AND b <> root.id AND b IN (SELECT id FROM node)),
      two AS (SELECT DISTINCT b AS id FROM way JOIN one ON a = one.id WHERE b IN (SELECT id FROM node) AND b NOT IN (SELECT id FROM one) AND b <> (SELECT id FROM root))
      SELECT id, 1 AS depth FROM one UNION ALL SELECT id, 2 FROM two""",
    "relevance_precision": f"""WITH {Q.RECORD}, r AS (SELECT id, content, regexp_extract(content, '^#* *([^\\n]+)', 1) AS title FROM record WHERE content_type = 'adr' AND content IS NOT NULL),
      q AS (SELECT id AS query, title, {Q.words("lower(title)")} AS terms FROM r WHERE trim(title) <> '' ORDER BY id LIMIT {QUERY_SET}),
      s AS (SELECT query, id, round(len(list_filter(terms, lambda t: contains(lower(content), t)))::DOUBLE / len(terms) / (1.0 + ln(greatest(len({Q.words("content")}), 1)::DOUBLE)), 6) AS score FROM r, q),
      k AS (SELECT query, id FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= {FIRST})
      SELECT round(avg((query IN (SELECT query FROM k WHERE id = query))::INTEGER)::DOUBLE, 6) AS precision FROM q""",
}
