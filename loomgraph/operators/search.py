"""Keyword, vector and hybrid search over symbols and content records.

Every top-k orders by score and then by id, in one TakeOrderedAndProject: no full sort, k rows per task move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.errors import error
from loomgraph.functions import text, vector

VECTOR_WEIGHT, KEYWORD_WEIGHT = 0.7, 0.3
DIGITS = 6
REGIONS = ("all", "code")


def top(df: DataFrame, limit: int, *order) -> DataFrame:
    """The first `limit` rows by score, highest first, then by the given columns."""
    return df.orderBy(F.col("score").desc(), *order).limit(limit)


def checked_query(query: str) -> str:
    """The trimmed query; QueryEmpty for nothing, QueryTooLong above 2000 bytes."""
    query = query.strip()
    if not query:
        raise error("QueryEmpty")
    if len(query.encode()) > text.QUERY_BYTES:
        raise error("QueryTooLong")
    return query


def keyword_search(records: DataFrame, query: str, limit: int = 10, id_column: str = "id") -> DataFrame:
    """(id, source_type, score) of the records with the best keyword score; rows without a hit keep score 0."""
    scored = records.select(F.col(id_column), F.col("content_type").alias("source_type"), F.round(text.keyword_score(F.lit(query), F.col("content")), DIGITS).alias("score"))
    return top(scored, limit, id_column)


def hybrid_search(records: DataFrame, query: str, query_vector, limit: int = 10, id_column: str = "id") -> DataFrame:
    """(id, source_type, score): 0.7 of the cosine, 0 if negative or without a vector, and 0.3 of the keyword score."""
    near = F.coalesce(vector.similarity(F.col("embedding"), query_vector), F.lit(0.0)) if query_vector is not None else F.lit(0.0)
    score = F.lit(VECTOR_WEIGHT) * near + F.lit(KEYWORD_WEIGHT) * text.keyword_score(F.lit(query), F.col("content"))
    return top(records.select(F.col(id_column), F.col("content_type").alias("source_type"), F.round(score, DIGITS).alias("score")), limit, id_column)


def similar(records: DataFrame, query_vector) -> DataFrame:
    """The records with a vector of the query's length, with their score: the cosine held to 0..1; NaN and infinite ones are dropped."""
    scored = records.where("embedding is not null").withColumn("score", vector.similarity(F.col("embedding"), query_vector))
    return scored.where("score is not null").withColumn("score", F.round("score", DIGITS))


def nearest_symbols(symbols: DataFrame, query_vector, limit: int, kinds: tuple[str, ...] = ()) -> DataFrame:
    """(id, kind, name, file_path, score) of the symbols nearest to the vector; limit 0 gives none."""
    wanted = symbols.where(F.col("kind").isin(*kinds)) if kinds else symbols
    return top(similar(wanted, query_vector), limit, "id").select("id", "kind", "name", "file_path", "score")


def nearest_content(records: DataFrame, query_vector, limit: int, content_type: str | None = None, id_column: str = "id") -> DataFrame:
    """(id, content_type, file_path, score) of the records nearest to the vector; the type filter comes first, so the result is exact."""
    wanted = records.where(F.col("content_type") == content_type) if content_type else records
    return top(similar(wanted, query_vector), limit, id_column).select(id_column, "content_type", "file_path", "score")


def content_by_keyword(records: DataFrame, query: str, content_type: str | None = None) -> DataFrame:
    """Records with any query term, score the share of terms found; used where no vector is near."""
    wanted = records.where(F.col("content_type") == content_type) if content_type else records
    scored = wanted.withColumn("score", F.round(text.term_share(F.lit(query), F.col("content")), DIGITS))
    return scored.where("score > 0")


def merged(code: DataFrame, content: DataFrame, limit: int) -> DataFrame:
    """(region, id, node_type, title, file_path, line_range, summary, score) of both, best first, code before content on ties."""
    columns = ["region", "id", "node_type", "title", "file_path", "line_range", "summary", "score"]
    a = code.select(
        F.lit("code").alias("region"), "id", F.col("kind").alias("node_type"), F.col("name").alias("title"), "file_path", text.line_range(F.col("line_start"), F.col("line_end")).alias("line_range"), text.summary(F.col("summary")).alias("summary"), "score"
    )
    b = content.select(
        F.lit("content").alias("region"), "id", F.col("content_type").alias("node_type"), F.col("file_path").alias("title"), "file_path", F.lit(None).cast("string").alias("line_range"), text.summary(F.col("content")).alias("summary"), "score"
    )
    return top(a.unionByName(b), limit, "region", "id").select(*columns)


def unified(symbols: DataFrame, records: DataFrame, query: str, query_vector, limit: int = 10, region: str = "all", content_type: str | None = None) -> DataFrame:
    """Search over code and content: both branches' nearest, merged. Without a vector, or where no content is near, content
    is found by keyword. limit is held to 1..50; region is one of REGIONS and, as it always was, is only checked."""
    if region not in REGIONS:
        raise error("InvalidParams", f"unknown region {region!r}")
    query, limit = checked_query(query), min(max(limit, 1), 50)
    if query_vector is None:
        code = symbols.withColumn("score", F.lit(0.0)).limit(0)
        return merged(code, top(content_by_keyword(records, query, content_type), limit, "id"), limit)
    code = top(similar(symbols, query_vector), limit, "id")
    wanted = records.where(F.col("content_type") == content_type) if content_type else records
    near = top(similar(wanted, query_vector), limit, "id")
    if near.isEmpty():
        near = top(content_by_keyword(records, query, content_type), limit, "id")
    return merged(code, near, limit)


def precision_at(results: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """One row, precision: the mean over queries of the share of expected ids among the first k results.

    results (query, id, rank), expected (query, id)."""
    hits = results.where(F.col("rank") <= k).join(expected, ["query", "id"], "left_semi").groupBy("query").agg(F.count("*").alias("hits"))
    sizes = expected.groupBy("query").agg(F.least(F.count("*"), F.lit(k)).alias("most"))
    return sizes.join(hits, "query", "left").agg(F.round(F.avg(F.coalesce("hits", F.lit(0)) / F.col("most")), DIGITS).alias("precision"))
