"""Neighbourhoods in the typed graph: level-wise joins, one materialised frontier per level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators.search import similar, top
from loomgraph.session import stage
from loomgraph.sources.model import EDGE_TYPES

DEPTH_MOST = 5
NODES_MOST = 50


def edge_rank(column: str = "edge_type") -> Column:
    return F.array_position(F.array(*[F.lit(e) for e in EDGE_TYPES]), F.col(column))


def links(edges: DataFrame, types: tuple[str, ...] = EDGE_TYPES) -> DataFrame:
    """The distinct links (edge_type, src, dst) of the types; links with a null or blank end are none."""
    real = edges.where(F.col("edge_type").isin(*(types or EDGE_TYPES)) & (F.trim("src") != "") & (F.trim("dst") != ""))
    return real.select("edge_type", "src", "dst").distinct()


def outbound(edges: DataFrame, node: str) -> DataFrame:
    """(edge_type, dst) of the links that leave a node."""
    return links(edges).where(F.col("src") == node).select("edge_type", "dst")


def inbound(edges: DataFrame, node: str) -> DataFrame:
    """(edge_type, src) of the links that reach a node."""
    return links(edges).where(F.col("dst") == node).select("edge_type", "src")


def neighbourhood(nodes: DataFrame, edges: DataFrame, root: str, depth: int = 1, most: int | None = NODES_MOST, types: tuple[str, ...] = EDGE_TYPES) -> tuple[DataFrame, bool]:
    """The nodes around a root, breadth first along links of either direction, and whether there were more than `most`.

    (id, kind, name, file_path, depth, edge_type, src, dst, found): each node once, with the link it was found by: that of the
    earliest found neighbour, outgoing before incoming, in order of EDGE_TYPES. The root is none of them. Ends that are no record
    are not followed. depth is held to 1..5; most None means all. Order of `found` is that of discovery, ties by id.
    """
    depth = min(max(depth, 1), DEPTH_MOST)
    link, nodes = links(edges, types), nodes.select("id", "kind", "name", "file_path")
    if depth > 1:  # what every level joins is made distinct and narrow once
        link, nodes = stage(link, "links"), stage(nodes, "nodes")
    both = link.select(F.col("src").alias("at"), F.col("dst").alias("to"), "edge_type", "src", "dst", F.lit(0).alias("way")).unionByName(
        link.select(F.col("dst").alias("at"), F.col("src").alias("to"), "edge_type", "src", "dst", F.lit(1).alias("way"))
    )
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(root, 0)], "at string, place long")
    seen = [spark.createDataFrame([(root,)], "to string")]
    out: list[DataFrame] = []
    held, truncated = 0, False
    for level in range(1, depth + 1):
        visited = reduce(DataFrame.unionByName, seen)
        step = both.join(frontier, "at").join(visited, "to", "left_anti")
        order = ["place", "way", "rank", "to"]
        first = W.partitionBy("to").orderBy(*order)
        step = step.withColumn("rank", edge_rank()).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
        step = stage(step.join(nodes.withColumnRenamed("id", "to"), "to", "left"), "level")
        known = step.where("kind is not null")
        place = F.lit(0)
        if most is None:
            # Without a cap only levels are ordered, and a level needs no job besides the one that writes it.
            if step.isEmpty():
                break
        else:
            here = step.agg(F.count("*").alias("n"), F.count("kind").alias("known")).first()
            truncated = held + here.known > most or (held >= most and here.n > 0)
            place = F.row_number().over(W.orderBy(*order)) + held
            known = known.orderBy(*order).limit(max(0, most - held))
            held = min(most, held + here.known)
            if not here.n:
                break
        known = known.withColumn("found", place)
        out.append(known.select(F.col("to").alias("id"), "kind", "name", "file_path", F.lit(level).alias("depth"), "edge_type", "src", "dst", "found"))
        if truncated:
            break
        seen.append(step.select("to"))
        frontier = known.select(F.col("to").alias("at"), F.col("found").cast("long").alias("place"))
    if not out:
        out.append(spark.createDataFrame([], "id string, kind string, name string, file_path string, depth int, edge_type string, src string, dst string, found int"))
    return reduce(DataFrame.unionByName, out), truncated


def reachable(edges: DataFrame, root: str, depth: int, types: tuple[str, ...] = EDGE_TYPES) -> DataFrame:
    """(id): what 1 to `depth` (at most 5) outgoing links lead to; the root too, if a cycle leads back. Depth 0 gives none."""
    spark = edges.sparkSession
    link = links(edges, types).select("src", "dst").distinct()
    level = spark.createDataFrame([(root,)], "src string")
    out = [spark.createDataFrame([], "id string")]
    for _ in range(min(max(depth, 0), DEPTH_MOST)):
        level = stage(link.join(level, "src", "left_semi").select(F.col("dst").alias("src")).distinct(), "reach")
        out.append(level.select(F.col("src").alias("id")))
    return reduce(DataFrame.unionByName, out).distinct()


def reachable_nearest(symbols: DataFrame, edges: DataFrame, root: str, depth: int, query_vector, limit: int, types: tuple[str, ...] = EDGE_TYPES) -> DataFrame:
    """(id, kind, name, file_path, score) of the symbols nearest to the vector among those reachable from the root."""
    inside = symbols.join(reachable(edges, root, depth, types), "id", "left_semi")
    return top(similar(inside, query_vector), limit, "id").select("id", "kind", "name", "file_path", "score")


def task_links(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(task, id, name, kind) of each concerns link; name and kind are '' where the symbol is not there."""
    c = links(edges, ("concerns",)).select(F.col("src").alias("task"), F.col("dst").alias("id"))
    return c.join(symbols.select("id", "name", "kind"), "id", "left").select("task", "id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("kind", F.lit("")).alias("kind"))


def links_of_tasks(tasks: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(task, links): for each task (column id) how many concerns links it has; 0 without any."""
    n = task_links(symbols, edges).groupBy("task").agg(F.count("*").alias("links"))
    return tasks.select(F.col("id").alias("task")).distinct().join(n, "task", "left").select("task", F.coalesce("links", F.lit(0)).alias("links"))


def concerns_in_file(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, task, id): the tasks concerned with the symbols of each file."""
    c = links(edges, ("concerns",)).select(F.col("src").alias("task"), F.col("dst").alias("id"))
    return symbols.select("id", "file_path").join(c, "id").select("file_path", "task", "id")


def link_exists(edges: DataFrame, edge_type: str, src: str, dst: str) -> DataFrame:
    """One row, there: is there such a link?"""
    return edges.where((F.col("edge_type") == edge_type) & (F.col("src") == src) & (F.col("dst") == dst)).agg((F.count("*") > 0).alias("there"))


def tasks_of_ids(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(task, id) of the concerns links to the given ids (column id); ids without a table are left out."""
    typed = ids.where(F.instr("id", ":") > 0).select("id").distinct()
    return links(edges, ("concerns",)).select(F.col("src").alias("task"), F.col("dst").alias("id")).join(typed, "id", "left_semi").select("task", "id")
