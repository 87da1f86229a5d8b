"""Lookups, pages and counts over symbols, files and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import vector
from loomgraph.sources.model import KINDS

PAGE, PAGE_MOST = 50, 500

# The fields of a brief record.
BRIEF = ("id", "title", "status", "priority", "assignee")


def kind_rank(column: str = "kind") -> Column:
    """Functions before classes before interfaces."""
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col(column))


def symbol_filter(file_path: str | None = None, node_type: str | None = None, name: str | None = None, loose: bool = False) -> Column:
    """The condition of a listing. An unknown node_type means all. loose: as clients of old have it, a name that starts as asked passes whatever its file."""
    ok = F.lit(True)
    if node_type in KINDS:
        ok = ok & (F.col("kind") == node_type)
    in_file = F.col("file_path") == file_path if file_path else F.lit(True)
    if not name:
        return ok & in_file
    has, starts = F.contains(F.col("name"), F.lit(name)), F.startswith(F.col("name"), F.lit(name))
    return ok & ((in_file & has) | starts) if loose else ok & in_file & (has | starts)


def page(symbols: DataFrame, where: Column, limit: int = PAGE, offset: int = 0, per_kind: bool = False) -> DataFrame:
    """(name, kind, file_path, line_start, line_end, id) of one page in order of name and id; limit is held to 1..500.

    per_kind: limit and offset hold for each kind on its own, as where the kinds are tables."""
    limit, offset = min(max(limit, 1), PAGE_MOST), max(offset, 0)
    rows = symbols.where(where).select("name", "kind", "file_path", "line_start", "line_end", "id")
    if not per_kind:
        return rows.orderBy("name", "id").offset(offset).limit(limit)
    by = W.partitionBy("kind").orderBy("name", "id")
    return rows.withColumn("_n", F.row_number().over(by)).where((F.col("_n") > offset) & (F.col("_n") <= offset + limit)).drop("_n").orderBy("name", "id")


def total(symbols: DataFrame, where: Column, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """total_count of a listing, and whether rows follow the page."""
    n = symbols.where(where).agg(F.count("*").alias("total_count"))
    return n.select("total_count", (F.lit(offset + limit) < F.col("total_count")).alias("has_more"))


def by_name(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols of exactly that name, functions first, then by id."""
    return symbols.where(F.col("name") == name).orderBy(kind_rank(), "id")


def resolve(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the given ids (column id); ids of unknown tables and of no record give no row."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def counts_by_kind(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count("*").alias("n"))


def counts_by_edge(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("n"))


def coverage(symbols: DataFrame) -> DataFrame:
    """symbols_with_embeddings, total_symbols, coverage_percent (0 without symbols): who has a vector that is not all zero."""
    have = F.count_if(vector.is_meaningful(F.col("embedding")))
    return symbols.agg(have.alias("symbols_with_embeddings"), F.count("*").alias("total_symbols")).withColumn(
        "coverage_percent", F.round(F.when(F.col("total_symbols") > 0, F.col("symbols_with_embeddings") * 100.0 / F.col("total_symbols")).otherwise(0.0), 6)
    )


def statistics(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: code_files, functions, classes, interfaces, edges, and the vectors' coverage."""
    kinds = symbols.agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in zip(KINDS, ("functions", "classes", "interfaces"))])
    out = files.agg(F.count("*").alias("code_files"))
    for part in (kinds, edges.agg(F.count("*").alias("edges")), coverage(symbols)):
        out = out.join(part)  # one row each
    return out


def project(df: DataFrame, fields: list[str] | None = None, brief: bool = False) -> DataFrame:
    """df with the wanted fields that it has, in its own order; brief means BRIEF, nothing wanted means all."""
    wanted = fields or (list(BRIEF) if brief else df.columns)
    return df.select(*[c for c in df.columns if c in wanted])


def response_counts(tool: Column, response: Column) -> Column:
    """struct(symbols, results) a tool's JSON response holds, by the arrays the tool fills; 0 where there is none."""
    size = lambda path: F.coalesce(F.json_array_length(F.get_json_object(response, path)), F.lit(0))
    symbols = F.when(tool == "list_symbols", size("$.symbols")).when(tool == "map_code", size("$.neighbors") + F.when(F.get_json_object(response, "$.root").isNotNull(), 1).otherwise(0)).when(tool == "impact_analysis", size("$.code_neighborhood")).otherwise(0)
    results = F.when(tool.isin("unified_search", "query_memory"), size("$.results")).when(tool == "query_graph", size("$.rows")).when(tool == "query_changes", size("$.commits")).otherwise(symbols)
    return F.struct(symbols.alias("symbols"), results.alias("results"))
