"""Parent-child links to full hierarchies: depth, root, path and descendants of every node, and cycles.

A frontier of resolved nodes grows from the roots by joins, level upon level. One join per level would need as
many jobs as the deepest history has commits, so the stride doubles: after round k every unresolved node knows its
ancestor 2^k links up, and joining it with the frontier (all nodes of depth below 2^k) resolves depths up to
2^(k+1). If a round reaches nobody while nodes are left, none of them will ever reach a root: were there a root
above one, its ancestor at depth 2^k would have been reached. These are the cycles and what hangs below them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import stage


def key(c: Column | str) -> Column:
    """The comparison form of a hash: no letter case, no outer blanks."""
    return F.lower(F.trim(c, F.lit(" \t\r\n")))


def first_parents(commits: DataFrame) -> DataFrame:
    """(node, hash, parent) of each commit, once: parent is the first entry of parent_hashes that is neither null nor blank.

    Rows without a hash are left out. Should rows of one hash disagree, the smallest parent counts.
    """
    real = F.filter("parent_hashes", lambda p: p.isNotNull() & p.rlike(r"\S"))
    parent = F.when(F.size(real) > 0, key(F.element_at(real, 1)))
    return (
        commits.select(key("hash").alias("node"), F.col("hash"), parent.alias("parent"))
        .where("node is not null and node <> ''")
        .groupBy("node")
        .agg(F.min("hash").alias("hash"), F.min("parent").alias("parent"))
    )


def resolve(links: DataFrame) -> DataFrame:
    """links (node, parent; node unique) to (node, root, depth); root '' and depth -1 for lines that never end.

    A node without parent, or whose parent is no node, is a root of depth 0. No links give no rows.
    """
    links = links.select("node", "parent")
    up = links.join(links.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", F.col("parent").alias("up"))
    up = stage(up, "links")
    done = [stage(links.join(up.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"), F.lit(0).alias("depth")), "level")]
    if up.isEmpty():
        return done[0]
    stride, left = 1, up
    while True:
        frontier = done[0]
        for d in done[1:]:
            frontier = frontier.unionByName(d)
        f = frontier.select(F.col("node").alias("up"), F.col("root").alias("r"), F.col("depth").alias("d"))
        step = stage(left.join(f, "up", "left").select("node", "up", F.col("r").alias("root"), (F.col("d") + stride).alias("depth")), "step")
        n = step.agg(F.count("*").alias("all"), F.count("root").alias("reached")).first()
        if not n.reached:
            done.append(step.select("node", F.lit("").alias("root"), F.lit(-1).alias("depth")))
            break
        done.append(step.where("root is not null").select("node", "root", "depth"))
        if n.reached == n["all"]:
            break
        rest = step.where("root is null").select("node", "up")
        # All that is left has an ancestor 2 x stride up, or the frontier would have reached it.
        left = stage(rest.join(left.select(F.col("node").alias("up"), F.col("up").alias("further")), "up").select("node", F.col("further").alias("up")), "left")
        stride *= 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _resolved(commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commits by node, and the root and depth of each."""
    nodes = stage(first_parents(commits), "commits")
    return nodes, resolve(nodes)


def forest(commits: DataFrame) -> DataFrame:
    """hash, root_hash, depth of each commit, one row per commit; root_hash '' and depth -1 on lines that never end."""
    nodes, found = _resolved(commits)
    named = found.join(nodes.select("node", "hash"), "node")
    roots = nodes.select(F.col("node").alias("root"), F.col("hash").alias("root_hash"))
    return named.join(roots, "root", "left").select("hash", F.coalesce("root_hash", F.lit("")).alias("root_hash"), "depth")


def ancestors(commits: DataFrame) -> DataFrame:
    """(hash, ancestor, distance) for each commit and each of its ancestors, distance from 1; each pair once.

    Seen from the ancestor these are all its descendants. Commits on lines that never end have none.
    Pairs stay rows, so that no node's descendants meet in one task.
    """
    return _ancestors(*_resolved(commits))


def _ancestors(nodes: DataFrame, found: DataFrame) -> DataFrame:
    sound = found.where("depth > 0").select("node", "depth")
    jump = stage(nodes.select("node", F.col("parent").alias("up")).join(sound, "node"), "jump")
    pairs = [jump.select("node", F.col("up").alias("ancestor"), F.lit(1).alias("distance"))]
    stride, deepest = 1, jump.agg(F.max("depth")).first()[0] or 0
    while stride < deepest:
        near = pairs[0]
        for p in pairs[1:]:
            near = near.unionByName(p)
        further = near.select(F.col("node").alias("up"), "ancestor", "distance")
        pairs.append(stage(jump.join(further, "up").select("node", "ancestor", (F.col("distance") + stride).alias("distance")), "pairs"))
        above = jump.select(F.col("node").alias("up"), F.col("up").alias("next"))
        jump = stage(jump.join(above, "up").select("node", F.col("next").alias("up"), "depth"), "jump")
        stride *= 2
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    names = nodes.select("node", "hash")
    return (
        out.join(names, "node")
        .join(names.select(F.col("node").alias("ancestor"), F.col("hash").alias("above")), "ancestor")
        .select("hash", F.col("above").alias("ancestor"), "distance")
    )


def paths(commits: DataFrame) -> DataFrame:
    """hash and path (array of hashes, root first, the commit last) of each commit that reaches a root.

    A path is as long as its commit is deep, whatever else is in the table.
    """
    nodes, found = _resolved(commits)
    above = _ancestors(nodes, found).groupBy("hash").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor"))), lambda x: x["ancestor"]).alias("above"))
    own = F.array("hash")
    sound = nodes.join(found.where("depth >= 0").select("node"), "node").select("hash")
    return sound.join(above, "hash", "left").select("hash", F.when(F.col("above").isNull(), own).otherwise(F.concat("above", own)).alias("path"))
