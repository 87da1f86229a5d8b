"""Common table expressions that the queries' SQL shares; each mirrors a view of sources.model."""

from __future__ import annotations

SYM = "sym AS (SELECT * FROM symbols WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, deleted_at DESC NULLS LAST) = 1)"
FILE = "file AS (SELECT * FROM code_file WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, deleted_at DESC NULLS LAST) = 1)"
EDGE = "edge AS (SELECT DISTINCT * FROM edges WHERE edge_type IN ('calls', 'imports', 'defines', 'inherits_from', 'concerns'))"
LINK = EDGE + ", link AS (SELECT DISTINCT edge_type, src, dst FROM edge WHERE trim(src) <> '' AND trim(dst) <> '')"
COMMIT = "commits AS (SELECT * FROM commit_node WHERE hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hash ORDER BY committed_at DESC NULLS LAST) = 1)"
NODE = SYM + ", " + FILE + ", node AS (SELECT id, kind, name, file_path FROM sym UNION ALL SELECT id, 'code_file', path, path FROM file)"
RECORD = """record AS (
  SELECT 'cr_' || sha256(coalesce(source, 'unsorted') || '/' || doc_id) AS id, doc_id, content_type, coalesce(source, 'unsorted') || '/' || doc_id AS file_path,
    sha256(text) AS content_hash, text AS content, coalesce(source, 'unsorted') AS source_path, strlen(text) AS file_size_bytes, ingested_at
  FROM documents)"""
VECTOR = RECORD + ", vrecord AS (SELECT r.*, e.embedding FROM record r LEFT JOIN embeddings e ON e.vec_id = r.doc_id)"
EVENT = """event AS (
  SELECT event_id, event_type AS tool_name, ts AS timestamp, floor(value)::BIGINT * 4 AS response_bytes, floor(value)::BIGINT AS estimated_tokens,
    json_extract_string(props, '$.k')::BIGINT % 11 AS results_returned, CASE WHEN day(ts) <= 15 THEN 'main' ELSE 'feature__x' END AS branch,
    user_id::VARCHAR AS connection_id, CASE WHEN user_id % 8 <> 0 THEN 'role_' || (user_id % 8) END AS agent_role,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS outcome, value AS elapsed_ms
  FROM events)"""

WHITE = r"[\s\x0B\x{85}\p{Z}]+"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{WHITE}'), lambda w: w <> '')"


def term_share(query: str, text: str) -> str:
    terms = words(f"lower('{query}')")
    return f"(CASE WHEN {text} IS NULL THEN 0.0 ELSE len(list_filter({terms}, lambda t: contains(lower({text}), t)))::DOUBLE / len({terms}) END)"


def keyword_score(query: str, text: str) -> str:
    return f"({term_share(query, text)} / (1.0 + ln(greatest(len({words(text)}), 1)::DOUBLE)))"


def summary(text: str) -> str:
    return (
        f"CASE WHEN length({text}) <= 200 THEN {text} WHEN contains(left({text}, 200), ' ')"
        f" THEN left({text}, 200 - strpos(reverse(left({text}, 200)), ' ')) || '…' ELSE left({text}, 200) || '…' END"
    )


FINITE = "len(list_filter({0}, lambda v: v IS NULL OR NOT isfinite(v))) = 0"


def similar(table: str, vector: str, condition: str = "true") -> str:
    """Rows of a table with a vector of the query's length, with their score; vector: a one-row subquery with column q."""
    return (
        f"SELECT t.*, round(greatest(least(list_cosine_similarity(t.embedding::DOUBLE[], q.q), 1.0), 0.0), 6) AS score FROM {table} t, ({vector}) q"
        f" WHERE t.embedding IS NOT NULL AND len(t.embedding) = len(q.q) AND {FINITE.format('t.embedding')} AND len(list_filter(t.embedding, lambda v: v <> 0)) > 0 AND {condition}"
        f" UNION ALL SELECT t.*, 0.0 FROM {table} t, ({vector}) q WHERE len(t.embedding) = len(q.q) AND len(list_filter(t.embedding, lambda v: v IS NULL OR v <> 0)) = 0 AND {condition}"
    )
