"""Connected components of a link table by repeated contraction, nothing but joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import stage


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (node, component), one row per node that has a link; component is the group's smallest node.

    Each round every node hooks onto the neighbour of smallest priority (a hash, so that chains in id order shrink
    as fast as any graph), and links are redrawn between the hooks. Self links are ignored; no links give no rows.
    """
    links = links.where("a <> b").select("a", "b").distinct()
    both = stage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    hooks = []
    while not both.isEmpty():
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(hooks))).alias("p"), F.col(c).alias("id"))  # noqa: B023, E731
        hook = stage(both.groupBy("a").agg(F.least(F.min(order("b")), F.min(order("a")))["id"].alias("to")).withColumnRenamed("a", "node"), "hooks")
        hooks.append(hook)
        moved = both.join(hook.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(hook.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        both = stage(moved.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
    if not hooks:
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    top = hooks[0]
    for hook in hooks[1:]:  # follow the hooks of later rounds
        top = top.join(hook.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    top = stage(top, "roots")
    names = top.groupBy("to").agg(F.min("node").alias("component"))
    return top.join(names, "to").select("node", "component")


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """known (node, component) of earlier links, brought up to further links (a, b): only the components that these join are worked on."""
    side = lambda c, name: known.select(F.col("node").alias(c), F.col("component").alias(name))
    placed = stage(links.where("a <> b").join(side("a", "p"), "a", "left").join(side("b", "q"), "b", "left").select("a", "b", F.coalesce("p", "a").alias("p"), F.coalesce("q", "b").alias("q")), "placed")
    if placed.isEmpty():
        return known
    joined = components(placed.select(F.col("p").alias("a"), F.col("q").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("top"))
    nodes = known.unionByName(placed.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("p").alias("component")), F.struct(F.col("b").alias("node"), F.col("q").alias("component")))).alias("n")).select("n.*").distinct())
    return stage(nodes.distinct().join(joined, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "merged")
