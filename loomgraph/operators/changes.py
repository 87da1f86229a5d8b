"""Change detection, keyed merges, and the joins that carry a graph over from one state to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import vector


def classify(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """path, kind, previous_hash, current_hash: what is added, modified (other size or hash) or deleted; the unchanged is left out.

    Both have file_path, content_hash, size_bytes, file_path unique."""
    s = stored.select(F.col("file_path").alias("path"), F.col("content_hash").alias("previous_hash"), F.col("size_bytes").alias("old_size"))
    d = disk.select(F.col("file_path").alias("path"), F.col("content_hash").alias("current_hash"), F.col("size_bytes").alias("new_size"))
    kind = (
        F.when(F.col("old_size").isNull() & F.col("previous_hash").isNull(), "added")
        .when(F.col("new_size").isNull() & F.col("current_hash").isNull(), "deleted")
        .when(~F.col("old_size").eqNullSafe(F.col("new_size")) | ~F.col("previous_hash").eqNullSafe(F.col("current_hash")), "modified")
    )
    return s.join(d, "path", "full_outer").select("path", kind.alias("kind"), "previous_hash", "current_hash").where("kind is not null")


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("kind").agg(F.count("*").alias("n"))


def is_stale(changes: DataFrame) -> DataFrame:
    """One row, stale: has anything changed?"""
    return changes.agg((F.count("*") > 0).alias("stale"))


def missing(known: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows of `known` whose key was not seen: deleted files, removed content."""
    return known.join(seen.select(key).distinct(), key, "left_anti")


def upsert(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """base with the updates' rows in place of, or beside, its own; of several updates of a key that of the greatest `version`."""
    by = W.partitionBy(key).orderBy(F.desc("version"))
    newest = updates.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")
    return base.join(newest.select(key), key, "left_anti").unionByName(newest.select(*base.columns))


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """base without the rows of the keys."""
    return base.join(keys.select(key).distinct(), key, "left_anti")


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose two ends are nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def clear_file(symbols: DataFrame, edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges without a file's symbols and the edges that touch them."""
    gone = symbols.where(F.col("file_path") == path).select("id")
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return symbols.where(F.col("file_path") != path), kept


def unlink(edges: DataFrame, symbols: DataFrame, task: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(edges that stay, edges removed): a task's concerns links to symbols of a name."""
    named = symbols.where(F.col("name") == name).select(F.col("id").alias("dst")).distinct()
    hit = (F.col("edge_type") == "concerns") & (F.col("src") == task)
    gone = edges.where(hit).join(named, "dst", "left_semi")
    return edges.where(~F.coalesce(hit, F.lit(False))).unionByName(edges.where(hit).join(named, "dst", "left_anti")), gone


def with_vectors(rows: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """rows with the new embedding where `vectors` (key, embedding) has one."""
    new = vectors.select(F.col(key), F.col("embedding").alias("_new"))
    return rows.join(new, key, "left").withColumn("embedding", F.coalesce("_new", "embedding")).drop("_new")


def drop_corrupt_vectors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row with the number removed): rows with a vector that is not all finite go, those without stay."""
    ok = F.col("embedding").isNull() | vector.is_finite(F.col("embedding"))
    return rows.where(ok), rows.agg(F.count_if(~ok).alias("removed"))


def first_of(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def carry_vectors(new: DataFrame, old: DataFrame) -> DataFrame:
    """new with the vector of an old symbol of the same name and body hash, if that is not all zero; `reused` tells."""
    usable = first_of(old.where(vector.is_meaningful(F.col("embedding"))), ["name", "body_hash"], "id").select("name", "body_hash", F.col("embedding").alias("_old"))
    out = new.join(usable, ["name", "body_hash"], "left")
    return out.withColumn("reused", F.col("_old").isNotNull()).withColumn("embedding", F.coalesce("_old", "embedding")).drop("_old")


def relink(links: DataFrame, new: DataFrame) -> DataFrame:
    """task, old_id, new_id, how: concerns links moved to the new symbols.

    links (task, id, name, body_hash, file_path, kind) are those of the old ones. The first new symbol of the same name and hash counts
    (how = identity), else the first of the same name, file and kind (name), else none (orphaned)."""
    same = first_of(new, ["name", "body_hash"], "file_path", "id").select("name", "body_hash", F.col("id").alias("a"))
    named = first_of(new, ["name", "file_path", "kind"], "line_start", "id").select("name", "file_path", "kind", F.col("id").alias("b"))
    out = links.join(same, ["name", "body_hash"], "left").join(named, ["name", "file_path", "kind"], "left")
    how = F.when(F.col("a").isNotNull(), "identity").when(F.col("b").isNotNull(), "name").otherwise("orphaned")
    return out.select("task", F.col("id").alias("old_id"), F.coalesce("a", "b").alias("new_id"), how.alias("how"))


def link_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst) of calls by name within one file; the callee is the first function of that name by line.

    calls (file_path, caller, callee); names that the file does not define give none."""
    fn = first_of(symbols.where("kind = 'function'"), ["file_path", "name"], "line_start", "id").select("file_path", "name", "id")
    a = fn.select("file_path", F.col("name").alias("caller"), F.col("id").alias("src"))
    b = fn.select("file_path", F.col("name").alias("callee"), F.col("id").alias("dst"))
    return calls.join(a, ["file_path", "caller"]).join(b, ["file_path", "callee"]).select("src", "dst").distinct()


def link_impls(impls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst) of `impl trait for struct` within one file. impls (file_path, struct, trait)."""
    one = lambda kind, name, out: first_of(symbols.where(F.col("kind") == kind), ["file_path", "name"], "line_start", "id").select("file_path", F.col("name").alias(name), F.col("id").alias(out))
    return impls.join(one("class", "struct", "src"), ["file_path", "struct"]).join(one("interface", "trait", "dst"), ["file_path", "trait"]).select("src", "dst").distinct()


def same_identity(symbols: DataFrame) -> DataFrame:
    """name, body_hash, n: identities that more than one symbol has."""
    return symbols.groupBy("name", "body_hash").agg(F.count("*").alias("n")).where("n > 1")


def sync_states(files: DataFrame, previous: DataFrame, languages: tuple[str, ...], most_bytes: int) -> DataFrame:
    """path, status of each file: empty, oversized, other_language, unchanged, or parse.

    files (path, language, size_bytes, content_hash), previous (path, content_hash)."""
    old = previous.select("path", F.col("content_hash").alias("_old"))
    status = (
        F.when(F.coalesce("size_bytes", F.lit(0)) == 0, "empty")
        .when(F.col("size_bytes") > most_bytes, "oversized")
        .when(~F.coalesce(F.col("language").isin(*languages), F.lit(False)), "other_language")
        .when(F.col("_old") == F.col("content_hash"), "unchanged")
        .otherwise("parse")
    )
    return files.join(old, "path", "left").select("path", status.alias("status"))


def drop_edges_from(edges: DataFrame, edge_type: str, src: str) -> DataFrame:
    """The edges without those of a type that leave a node."""
    return edges.where(~F.coalesce((F.col("edge_type") == edge_type) & (F.col("src") == src), F.lit(False)))


def drop_concerns_of(edges: DataFrame, symbol: str) -> tuple[DataFrame, DataFrame]:
    """(edges that stay, one row with the number removed): the concerns links to a symbol go."""
    hit = F.coalesce((F.col("edge_type") == "concerns") & (F.col("dst") == symbol), F.lit(False))
    return edges.where(~hit), edges.agg(F.count_if(hit).alias("removed"))
