"""Queries of search, listing and graph traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text, vector
from loomgraph.operators import graph, listing, search
from loomgraph.plans import sqlparts as Q
from loomgraph.sources import model
from loomgraph.sources.tables import table

QUERY = "Frozen digest must  clamp the policy"
NAME_PART = "new"
PREFIX = "re"
SYMBOL_VECTOR = "SELECT embedding::DOUBLE[] AS q FROM sym WHERE len(embedding) = 384 AND " + Q.FINITE.format("embedding") + " AND len(list_filter(embedding, lambda v: abs(v) > 1.1920929e-7)) > 0 ORDER BY id LIMIT 1"
CONTENT_VECTOR = "SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1"
ROOT = "SELECT dst FROM link WHERE edge_type = 'calls' AND dst IN (SELECT id FROM sym) GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1"
SOURCE = "SELECT src FROM link WHERE edge_type = 'calls' AND src IN (SELECT id FROM sym) GROUP BY src ORDER BY count(*) DESC, src LIMIT 1"


def symbol_vector(symbols: DataFrame) -> list[float]:
    """The query vector of the examples: that of the first symbol with a usable one."""
    ok = model.usable_vector("embedding", 384) & vector.is_meaningful(F.col("embedding"))
    return symbols.where(ok).orderBy("id").select("embedding").first()[0]


def content_vector(spark: SparkSession, folder: str) -> list[float]:
    return table(spark, folder, "embeddings").orderBy("vec_id").select("embedding").first()[0]


def busiest(nodes: DataFrame, edges: DataFrame, end: str) -> str:
    """The symbol that most distinct calls reach (dst) or leave (src)."""
    calls = graph.links(edges, ("calls",)).join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return calls.groupBy(end).agg(F.count("*").alias("n")).orderBy(F.desc("n"), end).first()[0]


def memory_keyword_topk(spark, folder) -> DataFrame:
    return search.keyword_search(model.content_records(spark, folder), QUERY)


def memory_hybrid_topk(spark, folder) -> DataFrame:
    return search.hybrid_search(model.content_vectors(spark, folder), QUERY, content_vector(spark, folder))


def content_by_type(spark, folder) -> DataFrame:
    r = model.content_records(spark, folder)
    return r.where("content_type = 'adr'").select("id", "file_path", "content_hash", "file_size_bytes").orderBy("file_path")


def content_hashes(spark, folder) -> DataFrame:
    return model.content_records(spark, folder).select("id", "file_path", "content_hash", "file_size_bytes")


def knn_symbols(spark, folder) -> DataFrame:
    s = model.symbols(spark, folder)
    return search.nearest_symbols(s, symbol_vector(s), 20)


def knn_symbols_by_kind(spark, folder) -> DataFrame:
    s = model.symbols(spark, folder)
    return search.nearest_symbols(s, symbol_vector(s), 20, ("interface",))


def knn_content_filtered(spark, folder) -> DataFrame:
    return search.nearest_content(model.content_vectors(spark, folder), content_vector(spark, folder), 10, "spec")


def cosine_edge_cases(spark, folder) -> DataFrame:
    s = model.symbols(spark, folder)
    q = symbol_vector(s)
    e = F.col("embedding")
    return s.select("id", F.when(e.isNull() | ~vector.is_finite(e), -1.0).otherwise(F.round(vector.cosine(e, vector.literal(q)), 6)).alias("similarity"))


def unified_search(spark, folder) -> DataFrame:
    s, r = model.symbols(spark, folder), model.content_vectors(spark, folder)
    return search.unified(s, r, QUERY, symbol_vector(s), 20)


def unified_keyword_fallback(spark, folder) -> DataFrame:
    return search.unified(model.symbols(spark, folder), model.content_vectors(spark, folder), QUERY, None, 20)


def summary_truncate(spark, folder) -> DataFrame:
    return model.content_records(spark, folder).select("id", text.summary(F.col("content")).alias("summary"))


def symbols_page(spark, folder) -> DataFrame:
    return listing.page(model.symbols(spark, folder), listing.symbol_filter(name=NAME_PART), 50, 10)


def symbols_page_per_kind(spark, folder) -> DataFrame:
    return listing.page(model.symbols(spark, folder), listing.symbol_filter(name=NAME_PART), 20, 5, per_kind=True)


def symbols_loose_filter(spark, folder) -> DataFrame:
    where = listing.symbol_filter(file_path="crates/none.rs", name=PREFIX, loose=True)
    return listing.page(model.symbols(spark, folder), where, 500)


def symbols_total(spark, folder) -> DataFrame:
    return listing.total(model.symbols(spark, folder), listing.symbol_filter(node_type="function", name=NAME_PART), 50, 0)


def symbols_by_name(spark, folder) -> DataFrame:
    return listing.by_name(model.symbols(spark, folder), "new").select("id", "kind", "name", "file_path")


def symbols_of_files(spark, folder) -> DataFrame:
    s = model.symbols(spark, folder).where("kind = 'function'")
    return s.select("file_path", "line_start", "line_end", text.line_range(F.col("line_start"), F.col("line_end")).alias("lines"), "id", "name").orderBy("file_path", "line_start", "id")


def code_files_scan(spark, folder) -> DataFrame:
    return model.code_files(spark, folder).select("id", "path", text.language_of(F.col("path")).alias("language"), "size_bytes").orderBy("path")


def edges_scan(spark, folder) -> DataFrame:
    return model.edges(spark, folder).select("edge_type", "src", "dst", "edge_id").orderBy("edge_type", "src", "dst")


def resolve_ends(spark, folder) -> DataFrame:
    e = graph.links(model.edge_lines(spark, folder), ("imports",))
    ids = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id")))
    return listing.resolve(model.nodes(spark, folder), ids)


def workspace_statistics(spark, folder) -> DataFrame:
    return listing.statistics(model.code_files(spark, folder), model.symbols(spark, folder), model.edges(spark, folder))


def edge_type_counts(spark, folder) -> DataFrame:
    return listing.counts_by_edge(model.edges(spark, folder))


def kind_counts(spark, folder) -> DataFrame:
    return listing.counts_by_kind(model.symbols(spark, folder))


def embedding_coverage(spark, folder) -> DataFrame:
    return listing.coverage(model.symbols(spark, folder))


def bfs_neighborhood_nodes(spark, folder) -> DataFrame:
    n, e = model.nodes(spark, folder), model.edge_lines(spark, folder)
    out, _ = graph.neighbourhood(n, e, busiest(model.symbols(spark, folder), e, "dst"), 3, None)
    return out.select("id", "kind", "name", "depth")


def bfs_capped(spark, folder) -> DataFrame:
    n, e = model.nodes(spark, folder), model.edge_lines(spark, folder)
    out, truncated = graph.neighbourhood(n, e, busiest(model.symbols(spark, folder), e, "dst"), 1, 30)
    return out.select("id", "edge_type", "src", "dst", "depth", F.col("found").cast("long").alias("found"), F.lit(truncated).alias("truncated"))


def adjacency(spark, folder) -> DataFrame:
    e = model.edge_lines(spark, folder)
    root = busiest(model.symbols(spark, folder), e, "dst")
    out = graph.outbound(e, root).select("edge_type", F.lit("out").alias("way"), F.col("dst").alias("other"))
    return out.unionByName(graph.inbound(e, root).select("edge_type", F.lit("in").alias("way"), F.col("src").alias("other")))


def outbound_reachable(spark, folder) -> DataFrame:
    e = model.edge_lines(spark, folder)
    return graph.reachable(e, busiest(model.symbols(spark, folder), e, "src"), 4)


def hybrid_graph_knn(spark, folder) -> DataFrame:
    s, e = model.symbols(spark, folder), model.edge_lines(spark, folder)
    return graph.reachable_nearest(s, e, busiest(s, e, "src"), 3, symbol_vector(s), 20)


def impact_counts(spark, folder) -> DataFrame:
    n, e = model.nodes(spark, folder), model.edge_lines(spark, folder)
    out, _ = graph.neighbourhood(n, e, busiest(model.symbols(spark, folder), e, "dst"), 2, None)
    return out.groupBy("kind", "depth").agg(F.count("*").alias("n"))


def concerns_for_task(spark, folder) -> DataFrame:
    return graph.task_links(model.symbols(spark, folder), model.edge_lines(spark, folder))


def tasks_for_symbols(spark, folder) -> DataFrame:
    return graph.concerns_in_file(model.symbols(spark, folder), model.edge_lines(spark, folder))


def links_of_tasks(spark, folder) -> DataFrame:
    return graph.links_of_tasks(table(spark, folder, "backlog_item"), model.symbols(spark, folder), model.edge_lines(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        memory_keyword_topk, memory_hybrid_topk, content_by_type, content_hashes, knn_symbols, knn_symbols_by_kind, knn_content_filtered, cosine_edge_cases, unified_search,
        unified_keyword_fallback, summary_truncate, symbols_page, symbols_page_per_kind, symbols_loose_filter, symbols_total, symbols_by_name, symbols_of_files,
        code_files_scan, edges_scan, resolve_ends, workspace_statistics, edge_type_counts, kind_counts, embedding_coverage, bfs_neighborhood_nodes, bfs_capped, adjacency,
        outbound_reachable, hybrid_graph_knn, impact_counts, concerns_for_task, tasks_for_symbols, links_of_tasks,
    )
}

_HAS = f"(contains(name, '{NAME_PART}') OR starts_with(name, '{NAME_PART}'))"
_PAGE = "SELECT name, kind, file_path, line_start, line_end, id FROM "
_RANK = "list_position(['calls', 'imports', 'defines', 'inherits_from', 'concerns'], edge_type)"
_BOTH = "root AS (SELECT dst AS id FROM (" + ROOT + ")), both_ways AS (SELECT src AS a, dst AS b, edge_type, src, dst, 0 AS way FROM link UNION ALL SELECT dst, src, edge_type, src, dst, 1 FROM link)"


def _bfs(depth: int) -> str:
    return (
        f"WITH RECURSIVE {Q.NODE}, {Q.LINK}, {_BOTH}, walk AS (SELECT id, 0 AS depth FROM root UNION SELECT b, depth + 1 FROM walk JOIN both_ways ON a = walk.id WHERE depth < {depth} AND b IN (SELECT id FROM node)),"
        " near AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id HAVING min(depth) > 0) "
    )


_REACH = f"WITH RECURSIVE {Q.SYM}, {Q.LINK}, reach AS (SELECT src AS id, 0 AS depth FROM ({SOURCE}) UNION SELECT dst, depth + 1 FROM reach JOIN link ON src = reach.id WHERE depth < {{0}}) "
_TOP = "SELECT id, kind, name, file_path, score FROM hits ORDER BY score DESC, id LIMIT "
_COVER = "count(*) FILTER (WHERE len(list_filter(embedding, lambda v: abs(v) > 1.1920929e-7)) > 0)"
_CODE = f"SELECT 'code' AS region, id, kind AS node_type, name AS title, file_path, 'L' || line_start || '-L' || line_end AS line_range, {Q.summary('summary')} AS summary, score FROM c"
_FALLBACK = f"content AS (SELECT * FROM (SELECT *, round({Q.term_share(QUERY, 'content')}, 6) AS score FROM record) WHERE score > 0 ORDER BY score DESC, id LIMIT 20)"
_CONTENT = f"SELECT 'content' AS region, id, content_type AS node_type, file_path AS title, file_path, NULL::VARCHAR AS line_range, {Q.summary('content')} AS summary, score FROM content"

SQL = {
    "memory_keyword_topk": f"WITH {Q.RECORD} SELECT id, content_type AS source_type, round({Q.keyword_score(QUERY, 'content')}, 6) AS score FROM record ORDER BY score DESC, id LIMIT 10",
    "memory_hybrid_topk": f"""WITH {Q.VECTOR} SELECT id, content_type AS source_type,
      round(0.7::DOUBLE * greatest(coalesce(list_cosine_similarity(embedding::DOUBLE[], q), 0.0), 0.0) + 0.3::DOUBLE * {Q.keyword_score(QUERY, 'content')}, 6) AS score
      FROM vrecord, ({CONTENT_VECTOR}) ORDER BY score DESC, id LIMIT 10""",
    "content_by_type": f"WITH {Q.RECORD} SELECT id, file_path, content_hash, file_size_bytes FROM record WHERE content_type = 'adr'",
    "content_hashes": f"WITH {Q.RECORD} SELECT id, file_path, content_hash, file_size_bytes FROM record",
    "knn_symbols": f"WITH {Q.SYM}, hits AS ({Q.similar('sym', SYMBOL_VECTOR)}) {_TOP} 20",
    "knn_symbols_by_kind": f"""WITH {Q.SYM}, hits AS ({Q.similar('sym', SYMBOL_VECTOR, "kind = 'interface'")}) {_TOP} 20""",
    "knn_content_filtered": f"""WITH {Q.VECTOR}, hits AS ({Q.similar('vrecord', CONTENT_VECTOR, "content_type = 'spec'")}) SELECT id, content_type, file_path, score FROM hits ORDER BY score DESC, id LIMIT 10""",
    "cosine_edge_cases": f"""WITH {Q.SYM} SELECT id, CASE WHEN embedding IS NULL OR len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) > 0 THEN -1.0
      WHEN len(embedding) <> 384 OR len(list_filter(embedding, lambda v: v <> 0)) = 0 THEN 0.0 ELSE round(list_cosine_similarity(embedding::DOUBLE[], q), 6) END AS similarity FROM sym, ({SYMBOL_VECTOR})""",
    "unified_search": f"WITH {Q.SYM}, {Q.VECTOR}, c AS (SELECT * FROM ({Q.similar('sym', SYMBOL_VECTOR)}) ORDER BY score DESC, id LIMIT 20), {_FALLBACK} SELECT * FROM ({_CODE} UNION ALL {_CONTENT}) ORDER BY score DESC, region, id LIMIT 20",
    "unified_keyword_fallback": f"WITH {Q.RECORD}, {_FALLBACK} {_CONTENT}",
    "summary_truncate": f"WITH {Q.RECORD} SELECT id, {Q.summary('content')} AS summary FROM record",
    "symbols_page": f"WITH {Q.SYM} {_PAGE} sym WHERE {_HAS} ORDER BY name, id LIMIT 50 OFFSET 10",
    "symbols_page_per_kind": f"WITH {Q.SYM} {_PAGE} (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY name, id) AS n FROM sym WHERE {_HAS}) WHERE n > 5 AND n <= 25",
    "symbols_loose_filter": f"WITH {Q.SYM} {_PAGE} sym WHERE starts_with(name, '{PREFIX}') ORDER BY name, id LIMIT 500",
    "symbols_total": f"WITH {Q.SYM} SELECT count(*) AS total_count, 50 < count(*) AS has_more FROM sym WHERE kind = 'function' AND {_HAS}",
    "symbols_by_name": f"WITH {Q.SYM} SELECT id, kind, name, file_path FROM sym WHERE name = 'new'",
    "symbols_of_files": f"WITH {Q.SYM} SELECT file_path, line_start, line_end, 'L' || line_start || '-L' || line_end AS lines, id, name FROM sym WHERE kind = 'function'",
    "code_files_scan": f"""WITH {Q.FILE} SELECT id, path, coalesce(map {{'rs': 'rust', 'py': 'python', 'js': 'javascript', 'ts': 'typescript'}}[regexp_extract(path, '[^.]*$')], regexp_extract(path, '[^.]*$')) AS language, size_bytes FROM file""",
    "edges_scan": f"WITH {Q.EDGE} SELECT edge_type, src, dst, edge_id FROM edge",
    "resolve_ends": f"WITH {Q.NODE}, {Q.LINK} SELECT * FROM node WHERE id IN (SELECT src FROM link WHERE edge_type = 'imports' UNION SELECT dst FROM link WHERE edge_type = 'imports')",
    "workspace_statistics": f"""WITH {Q.SYM}, {Q.FILE}, {Q.EDGE} SELECT (SELECT count(*) FROM file) AS code_files, count(*) FILTER (WHERE kind = 'function') AS functions, count(*) FILTER (WHERE kind = 'class') AS classes,
      count(*) FILTER (WHERE kind = 'interface') AS interfaces, (SELECT count(*) FROM edge) AS edges, {_COVER} AS symbols_with_embeddings, count(*) AS total_symbols, round({_COVER} * 100.0::DOUBLE / count(*), 6) AS coverage_percent FROM sym""",
    "edge_type_counts": f"WITH {Q.EDGE} SELECT edge_type, count(*) AS n FROM edge GROUP BY 1",
    "kind_counts": f"WITH {Q.SYM} SELECT kind, count(*) AS n FROM sym GROUP BY 1",
    "embedding_coverage": f"WITH {Q.SYM} SELECT {_COVER} AS symbols_with_embeddings, count(*) AS total_symbols, round({_COVER} * 100.0::DOUBLE / count(*), 6) AS coverage_percent FROM sym",
    "bfs_neighborhood_nodes": _bfs(3) + "SELECT id, kind, name, depth FROM near JOIN node USING (id)",
    "bfs_capped": f"""WITH {Q.NODE}, {Q.LINK}, {_BOTH}, step AS (SELECT b AS id, edge_type, src, dst, way, {_RANK} AS rank FROM both_ways JOIN root ON a = root.id WHERE b <> root.id
      QUALIFY row_number() OVER (PARTITION BY b ORDER BY way, rank) = 1),
      placed AS (SELECT s.id, edge_type, src, dst, 1 AS depth, row_number() OVER (ORDER BY way, rank, s.id) AS found FROM step s JOIN node USING (id))
      SELECT *, (SELECT count(*) > 30 FROM placed) AS truncated FROM placed WHERE found <= 30""",
    "adjacency": f"WITH {Q.SYM}, {Q.LINK} SELECT edge_type, 'out' AS way, dst AS other FROM link WHERE src = ({ROOT}) UNION ALL SELECT edge_type, 'in', src FROM link WHERE dst = ({ROOT})",
    "outbound_reachable": _REACH.format(4) + "SELECT DISTINCT id FROM reach WHERE depth > 0",
    "hybrid_graph_knn": _REACH.format(3) + f", inside AS (SELECT * FROM sym WHERE id IN (SELECT id FROM reach WHERE depth > 0)), hits AS ({Q.similar('inside', SYMBOL_VECTOR)}) {_TOP} 20",
    "impact_counts": _bfs(2) + "SELECT kind, depth, count(*) AS n FROM near JOIN node USING (id) GROUP BY ALL",
    "concerns_for_task": f"WITH {Q.SYM}, {Q.LINK} SELECT src AS task, dst AS id, coalesce(name, '') AS name, coalesce(kind, '') AS kind FROM link LEFT JOIN sym ON id = dst WHERE edge_type = 'concerns'",
    "tasks_for_symbols": f"WITH {Q.SYM}, {Q.LINK} SELECT file_path, src AS task, id FROM link JOIN sym ON id = dst WHERE edge_type = 'concerns'",
    "links_of_tasks": f"WITH {Q.LINK} SELECT b.id AS task, count(l.src) AS links FROM (SELECT DISTINCT id FROM backlog_item) b LEFT JOIN link l ON l.src = b.id AND edge_type = 'concerns' GROUP BY 1",
}
