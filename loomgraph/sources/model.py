"""The tables as the operators see them: one row per record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text, vector
from loomgraph.sources.tables import table

EDGE_TYPES = ("calls", "imports", "defines", "inherits_from", "concerns")
KINDS = ("function", "class", "interface")


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest row of each key of a table of files.

    The choice is made on the key, the order and the row's place in its file alone, and only keys that stand there more than once
    are joined back: other columns are neither read for it nor moved, and filters on the result reach the scan."""
    place = [F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")]
    rows = df.where(F.col(key).isNotNull())
    newest = rows.select(key, F.struct(*order, *place).alias("_new")).groupBy(key).agg(F.max("_new").alias("_new"), F.count("*").alias("_times")).where("_times > 1")
    chosen = newest.select(F.col(key).alias("_key"), F.col("_new._file").alias("_new_file"), F.col("_new._at").alias("_new_at"))
    joined = rows.select("*", *place).join(chosen, F.col(key) == F.col("_key"), "left")
    return joined.where("_new_at is null or (_new_at = _at and _new_file = _file)").select(*df.columns)


def symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Functions, classes and interfaces, one row per id: the one loaded last."""
    return latest(table(spark, folder, "symbols"), "id", "loaded_at", "deleted_at")


def code_files(spark: SparkSession, folder: str) -> DataFrame:
    """Indexed files, one row per id: the one loaded last."""
    return latest(table(spark, folder, "code_file"), "id", "loaded_at", "deleted_at")


def edge_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Edges as they were delivered, some twice; enough where only distinct links matter."""
    return table(spark, folder, "edges").where(F.col("edge_type").isin(*EDGE_TYPES))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges, each delivered line once."""
    return edge_lines(spark, folder).distinct()


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """Commits, one row per hash."""
    return latest(table(spark, folder, "commit_node"), "hash", "committed_at")


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """(id, kind, name, file_path) of symbols and files; a file's name is its path."""
    s = symbols(spark, folder).select("id", "kind", "name", "file_path")
    f = code_files(spark, folder).select("id", F.lit("code_file").alias("kind"), F.col("path").alias("name"), F.col("path").alias("file_path"))
    return s.unionByName(f)


def content_records(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as content records."""
    d = table(spark, folder, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unsorted")), F.col("doc_id").cast("string"))
    return d.select(
        F.concat(F.lit("cr_"), F.sha2(path, 256)).alias("id"),
        "doc_id",
        "content_type",
        path.alias("file_path"),
        F.sha2("text", 256).alias("content_hash"),
        F.col("text").alias("content"),
        F.coalesce("source", F.lit("unsorted")).alias("source_path"),
        F.octet_length("text").cast("long").alias("file_size_bytes"),
        "ingested_at",
    )


def content_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Content records with the vector of their number, null where there is none."""
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return content_records(spark, folder).join(v, "doc_id", "left")


def usage_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as tool-usage events."""
    e = table(spark, folder, "events")
    tokens = F.floor("value").cast("long")
    role = F.when(F.col("user_id") % 8 == 0, None).otherwise(F.concat(F.lit("role_"), (F.col("user_id") % 8).cast("string")))
    return e.select(
        "event_id",
        F.col("event_type").alias("tool_name"),
        F.col("ts").alias("timestamp"),
        (tokens * text.TOKEN_BYTES).alias("response_bytes"),
        tokens.alias("estimated_tokens"),
        (F.get_json_object("props", "$.k").cast("long") % 11).alias("results_returned"),
        F.when(F.dayofmonth("ts") <= 15, F.lit("main")).otherwise(F.lit("feature__x")).alias("branch"),
        F.col("user_id").cast("string").alias("connection_id"),
        role.alias("agent_role"),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("success")).alias("outcome"),
        F.col("value").alias("elapsed_ms"),
    )


def usable_vector(column: str = "embedding", dimensions: int | None = None):
    """Is the vector there, finite, and of the dimensions?"""
    ok = F.col(column).isNotNull() & vector.is_finite(F.col(column)) & (F.size(column) > 0)
    return ok & (F.size(column) == dimensions) if dimensions else ok
