"""Writers of graph, event and summary files."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import vector
from loomgraph.session import join_parts, move, remove


def node_lines(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One JSON line per node, in order of the text: bodies are not written, vectors that are all zero left out, null fields omitted."""
    f = files.select(F.to_json(F.struct("id", F.lit("code_file").alias("type"), "path", "language", "size_bytes", "content_hash", F.date_format("last_indexed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_indexed_at"))).alias("line"))
    e = F.when(F.coalesce(vector.is_finite(F.col("embedding")), F.lit(False)) & vector.is_meaningful(F.col("embedding")), F.col("embedding")).alias("embedding")
    s = symbols.select(F.to_json(F.struct("id", F.col("kind").alias("type"), "name", "file_path", "line_start", "line_end", "signature", "docstring", "body_hash", "token_count", "embed_type", e, "summary")).alias("line"))
    return f.unionByName(s).orderBy("line")


def edge_lines(edges: DataFrame) -> DataFrame:
    """One JSON line per edge, in order of type, from, to."""
    at = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at")
    line = F.to_json(F.struct(F.col("edge_type").alias("type"), F.col("src").alias("from"), F.col("dst").alias("to"), "import_path", "linked_by", at))
    return edges.orderBy("edge_type", "src", "dst", "import_path", "linked_by", "created_at").select(line.alias("line"))


def write_lines(lines: DataFrame, path: str) -> int:
    """Write the column `line` to one text file in its order, put in place at once; a table without rows removes the file. Returns the rows.

    One file is the format: its lines come from the sorted partitions, streamed one after the other on the target's file system."""
    spark = lines.sparkSession
    folder, name = path.rsplit("/", 1) if "/" in path else (".", path)
    work = f"{folder}/.{name}.{uuid.uuid4().hex}"
    lines.select("line").write.text(work)
    n = spark.read.text(work).count()
    joined = f"{work}.joined"
    if n:
        join_parts(spark, work, joined)
    remove(spark, work)
    remove(spark, path)
    if n:
        move(spark, joined, path)
        remove(spark, f"{folder}/.{name}.crc")  # or nobody else could write to the file
    return n


def atomic_write(path: str, content: str) -> None:
    """Write a small text file so that readers see the old or the new one."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    work = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    with work.open("w", encoding="utf-8") as out:
        out.write(content)
        out.flush()
        os.fsync(out.fileno())
    os.replace(work, target)


def usage_lines(events: DataFrame) -> DataFrame:
    """branch and JSON line of each usage event, tokens being bytes by four where they are not given."""
    fields = [c for c in ("tool_name", "timestamp", "response_bytes", "estimated_tokens", "symbols_returned", "results_returned", "branch", "connection_id", "agent_role", "outcome") if c in events.columns]
    return events.select("branch", F.to_json(F.struct(*fields)).alias("line"))


def append_usage(path: str, event: dict) -> None:
    """Append one event to a usage file."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a", encoding="utf-8") as out:
        out.write(json.dumps({k: v for k, v in event.items() if v is not None}) + "\n")


def branch_folder(branch: Column) -> Column:
    """A branch's name as a folder name."""
    return F.replace(branch, F.lit("/"), F.lit("__"))


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Overwrite only the partitions that df has rows of."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.write.mode("overwrite").partitionBy(*by).parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def write_summary(summary: dict, path: str) -> None:
    """Write a summary of a branch's usage as one JSON file."""
    atomic_write(path, json.dumps(summary, indent=2, sort_keys=True, default=str))


def write_documents(rows: DataFrame, folder: str, prefix: str = "backlog") -> int:
    """Write each row as `prefix`-id.json, null fields omitted; returns the number. Rows are few: a file each is the format."""
    n = 0
    for r in rows.select("id", F.to_json(F.struct(*rows.columns)).alias("body")).toLocalIterator():
        atomic_write(f"{folder}/{prefix}-{r.id}.json", r.body)
        n += 1
    return n


def manifest(name: str, description: str | None, repository: str | None, branch: str | None, backlogs: DataFrame) -> dict:
    """The project manifest: its names, and id and path of each backlog in order."""
    rows = backlogs.select("id").orderBy("id").toLocalIterator()
    out = {"name": name, "description": description, "repository_url": repository, "default_branch": branch, "backlogs": [{"id": r.id, "path": f"backlog-{r.id}.json"} for r in rows]}
    return {k: v for k, v in out.items() if v is not None}


def write_project(folder: str, name: str, description: str | None, repository: str | None, branch: str | None, backlogs: DataFrame) -> dict:
    """Write the backlogs and project.json, their manifest; returns the manifest."""
    write_documents(backlogs, folder)
    out = manifest(name, description, repository, branch, backlogs)
    atomic_write(f"{folder}/project.json", json.dumps(out, indent=2))
    return out


def refresh_backlog(folder: str, backlogs: DataFrame, one: str) -> bool:
    """Write the one backlog of that id anew; False where there is none."""
    return write_documents(backlogs.where(F.col("id") == one), folder) == 1
