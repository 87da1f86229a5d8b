"""Queries over training data, with their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import docpairs, encoder, handwritten, leakage, multiindex, nearcode, spans, splitter
from loomgraph.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return handwritten.found(table(spark, folder, "code_file"), table(spark, folder, "source_file"))


def p1_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return handwritten.verdicts(table(spark, folder, "code_file"), table(spark, folder, "source_file"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return docpairs.found(table(spark, folder, "source_file"), table(spark, folder, "extracted_function"))


def p3_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return docpairs.pairs(table(spark, folder, "source_file"), table(spark, folder, "extracted_function"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return nearcode.found(table(spark, folder, "extracted_function"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return nearcode.groups(table(spark, folder, "extracted_function"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return multiindex.pairs(multiindex.neighbours(table(spark, folder, "symbols")))


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return multiindex.neighbours(table(spark, folder, "symbols"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitter.oversized(table(spark, folder, "extracted_function"), table(spark, folder, "embedding_config"))


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitter.split_bodies(table(spark, folder, "extracted_function"), table(spark, folder, "embedding_config"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoder.encode(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.found(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.found(table(spark, folder, "documents"))


def p10_shared(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shares(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_verdicts, p3_found, p3_pairs, p4_found, p4_groups, p5_found, p5_neighbours, p7_found, p7_pieces, p8_ids, p9_found, p9_leaks, p10_found, p10_shared)}

_P5 = """
WITH latest AS (
  SELECT id, embed_type, embedding::DOUBLE[] AS v FROM symbols
  WHERE kind = 'interface' AND embed_type IN ('explicit_code', 'summary_pointer') AND len(embedding) = 384
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) = 1),
scored AS (
  SELECT a.id, b.id AS neighbour, round(list_cosine_similarity(a.v, b.v), 6) AS similarity
  FROM latest a JOIN latest b ON a.embed_type = b.embed_type AND a.id <> b.id),
near AS (
  SELECT id, neighbour, similarity, (row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour))::INTEGER AS rank
  FROM scored WHERE similarity >= 0.6 QUALIFY rank <= 5)
"""

_P4 = """
WITH RECURSIVE f AS (SELECT DISTINCT fn_id, body FROM extracted_function WHERE body IS NOT NULL),
b AS (SELECT body, min(fn_id) AS rep FROM f GROUP BY 1),
t AS (SELECT rep, regexp_extract_all(body, '[A-Za-z0-9_]+') AS w FROM b),
s AS (SELECT DISTINCT rep, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM t WHERE len(w) >= 3),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.rep AS a, y.rep AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.rep < y.rep GROUP BY 1, 2),
link AS (SELECT a, b FROM c JOIN n p ON p.rep = a JOIN n q ON q.rep = b WHERE 10 * common >= 7 * (p.n + q.n - common)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT rep, rep AS other FROM b UNION SELECT r.rep, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
g AS (SELECT rep, min(other) AS group_id FROM reach GROUP BY 1),
m AS (SELECT fn_id, group_id FROM f JOIN b USING (body) JOIN g USING (rep))
"""

SQL = {
    "p4_found": _P4 + "SELECT x.fn_id AS fn_id_a, y.fn_id AS fn_id_b FROM m x JOIN m y ON x.group_id = y.group_id AND x.fn_id < y.fn_id",
    "p4_groups": _P4 + "SELECT fn_id, group_id FROM m WHERE group_id IN (SELECT group_id FROM m GROUP BY 1 HAVING count(*) > 1)",
    "p5_found": _P5 + "SELECT DISTINCT least(id, neighbour) AS id_a, greatest(id, neighbour) AS id_b FROM near",
    "p5_neighbours": _P5 + "SELECT * FROM near",
    "p7_found": """
SELECT DISTINCT f.fn_id FROM extracted_function f
LEFT JOIN (SELECT workspace, min(token_limit) AS token_limit FROM embedding_config GROUP BY 1) c USING (workspace)
WHERE strlen(f.body) // 4 > coalesce(c.token_limit, 512)""",
    "p9_found": """
WITH item AS (
  SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_item WHERE text IS NOT NULL),
doc AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
want AS (
  SELECT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram
  FROM (SELECT *, least(12, len(w)) AS n FROM item WHERE len(w) > 0)),
have AS (
  SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram
  FROM doc, (SELECT DISTINCT n FROM want) WHERE len(w) >= n)
SELECT DISTINCT doc_id, item_id FROM have JOIN want USING (n, gram)""",
    "p10_found": """
WITH win AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(text) - 398), lambda i: md5_number(substring(text, i, 400)))) AS h
  FROM documents WHERE length(text) >= 400)
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM win a JOIN win b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p10_shared": """
WITH RECURSIVE place AS (
  SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS pos FROM documents WHERE length(text) >= 400),
win AS (SELECT doc_id, pos, md5_number(substring(text, pos, 400)) AS h FROM place),
hold AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT doc_id, pos, first FROM win JOIN hold USING (h)),
next AS (SELECT doc_id, least(coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - pos, 400), 400) AS n FROM hit),
cover AS (SELECT doc_id, sum(n)::BIGINT AS shared_chars FROM next GROUP BY 1),
link AS (SELECT DISTINCT doc_id AS a, first AS b FROM hit),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, b AS other FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
class AS (SELECT doc_id, min(other) AS class_id, count(*) AS class_size FROM reach GROUP BY 1)
SELECT doc_id, class_id, class_size, length(text) AS chars, shared_chars, round(shared_chars / length(text), 6) AS shared_ratio
FROM class JOIN cover USING (doc_id) JOIN documents USING (doc_id)""",
}
