"""Readers of source trees, graph and event files, configuration and git history."""

from __future__ import annotations

import re
import subprocess
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.errors import error
from loomgraph.functions import text
from loomgraph.session import exists, tail
from loomgraph.sources.model import EDGE_TYPES, KINDS

MAX_FILE_BYTES = 1 << 20

NODE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "type", "name", "file_path")]
    + [T.StructField(n, T.IntegerType()) for n in ("line_start", "line_end")]
    + [T.StructField(n, T.StringType()) for n in ("signature", "docstring", "body_hash")]
    + [T.StructField("token_count", T.IntegerType()), T.StructField("embed_type", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("summary", T.StringType())]
    + [T.StructField("path", T.StringType()), T.StructField("language", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("content_hash", T.StringType()), T.StructField("last_indexed_at", T.StringType())]
)
EDGE = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "from", "to", "import_path", "linked_by", "created_at")])
USAGE = T.StructType(
    [T.StructField("tool_name", T.StringType()), T.StructField("timestamp", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in ("response_bytes", "estimated_tokens", "symbols_returned", "results_returned")]
    + [T.StructField(n, T.StringType()) for n in ("branch", "connection_id", "agent_role", "outcome")]
)


def _rule(line: str, base: str) -> tuple[str, bool, bool] | None:
    """(regular expression of a path, directories only, taken back) of a line of an ignore file that lies in `base`; None for none."""
    rule = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not rule or rule.startswith("#"):
        return None
    back = rule.startswith("!")
    rule = rule[1:] if back else rule
    folders = rule.endswith("/")
    rule = rule.rstrip("/")
    anchored = "/" in rule
    rule = rule.lstrip("/")
    if not rule:
        return None
    out = "" if anchored or rule.startswith("**") else "(?:.*/)?"
    parts = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    for token in re.findall(r"^\*\*/|/\*\*/|/\*\*$|\*+|\?|\[[^\]]+\]|\\.|.", rule):
        if token == "/**/":
            out += "/(?:.*/)?"
        elif token.startswith("[") and len(token) > 1:
            out += "[^" + token[2:] if token[1] == "!" else token
        elif token.startswith("\\"):
            out += re.escape(token[1:])
        else:
            out += parts.get(token) or parts["*"] if token in parts or set(token) == {"*"} else re.escape(token)
    return f"^{re.escape(base + '/') if base else ''}{out}$", folders, back


def ignore_rules(root: str) -> list[tuple[str, bool, bool]]:
    """The rules of all ignore files of a work tree, in the order in which later ones prevail: those of git, if it is a repository, and
    .ignore files, deeper ones after those above them."""
    top = Path(root).resolve()
    git = any((p / ".git").exists() for p in (top, *top.parents))
    out = [_rule(x, "") for x in (top / ".git/info/exclude").read_text(errors="replace").split("\n")] if (top / ".git/info/exclude").is_file() else []
    names = (".gitignore", ".ignore") if git else (".ignore",)
    found = [p for name in names for p in top.rglob(name) if p.is_file()]
    for p in sorted(found, key=lambda p: (len(p.parts), names.index(p.name))):
        base = "" if p.parent == top else p.parent.relative_to(top).as_posix()
        out += [_rule(x, base) for x in p.read_text(errors="replace").split("\n")]
    return [r for r in out if r]


def is_ignored(path: Column, rules: list[tuple[str, bool, bool]]) -> Column:
    """Is a path, or a directory on it, ignored? The last rule that matches decides, and nothing below an ignored directory is taken back."""
    if not rules:
        return F.lit(False)
    parts = F.split(path, "/")
    n = F.size(parts)

    def decided(i: Column) -> Column:
        at = F.array_join(F.slice(parts, 1, i), "/")
        out = F.lit(False)
        for regex, folders, back in rules:
            hit = at.rlike(regex) & (i < n) if folders else at.rlike(regex)
            out = F.when(hit, F.lit(not back)).otherwise(out)
        return out

    return F.exists(F.sequence(F.lit(1), n), decided)


def tracked(spark: SparkSession, root: str) -> DataFrame:
    """file_path (relative), content_hash, size_bytes, recorded_at of every file below a folder but those of excluded directories."""
    base = "file:" + str(Path(root).resolve()) + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", "^" + re.escape(base), "")
    rows = raw.select(rel.alias("file_path"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size_bytes"), F.current_timestamp().cast("timestamp_ntz").alias("recorded_at"))
    return rows.where(~text.is_excluded(F.col("file_path")))


def tree(spark: SparkSession, root: str, languages: tuple[str, ...] = ("rust",), exclude: tuple[str, ...] = (), most_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """path (relative), language, size_bytes, content_hash, source of the files below a folder in the given languages.

    Hidden files and directories, those that the tree's ignore files name, excluded ones (text.EXCLUDED and the globs), larger and
    binary files are left out."""
    base = "file:" + str(Path(root).resolve()) + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", "^" + re.escape(base), "")
    rows = raw.select(rel.alias("path"), F.col("length").alias("size_bytes"), "content").withColumn("language", text.language_of(F.col("path")))
    rows = rows.where(~F.col("path").rlike(r"(^|/)\.[^/]") & ~text.is_excluded(F.col("path")) & F.col("language").isin(*languages) & (F.col("size_bytes") <= most_bytes))
    rows = rows.where(~is_ignored(F.col("path"), ignore_rules(root)))
    for pattern in exclude:
        if text.glob_regex(pattern):
            rows = rows.where(~text.matches_glob(F.col("path"), pattern))
    rows = rows.where(~text.is_binary(F.col("content")))
    return rows.select("path", "language", "size_bytes", F.sha2("content", 256).alias("content_hash"), F.decode("content", "UTF-8").alias("source"))


def documents(spark: SparkSession, root: str, source_path: str, content_type: str, pattern: str | None = None, most_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Content records of the files below root/source_path, or of that one file; the glob is held against the path below the source."""
    at = Path(root) / source_path
    base = "file:" + str(Path(root).resolve()) + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(at))
    rel = F.regexp_replace("path", "^" + base.replace(".", "\\."), "")
    rows = raw.select(rel.alias("file_path"), F.col("length").alias("file_size_bytes"), "content")
    below = F.substring("file_path", len(source_path.rstrip("/")) + 2, 1 << 30) if at.is_dir() else F.col("file_path")
    rows = rows.where(text.matches_glob(below, pattern, or_name=at.is_file()) & (F.col("file_size_bytes") <= most_bytes) & ~text.is_binary(F.col("content")))
    return rows.select(
        F.concat(F.lit("cr_"), F.sha2("file_path", 256)).alias("id"),
        F.lit(content_type).alias("content_type"),
        "file_path",
        F.sha2("content", 256).alias("content_hash"),
        F.decode("content", "UTF-8").alias("content"),
        F.lit(source_path).alias("source_path"),
        "file_size_bytes",
    )


def _lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The parsed lines of a JSON-lines file, the raw text in `_line`, null in all fields where it is no JSON; blank lines are left out."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.col("value").alias("_line")).select("r.*", "_line")


def read_nodes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, skipped): the lines of a node file, and those that are corrupt, of an unknown type or without an id."""
    rows = _lines(spark, path, NODE)
    ok = F.coalesce(F.col("id").isNotNull() & F.col("type").isin(*KINDS, "code_file"), F.lit(False))
    return rows.where(ok).drop("_line"), rows.where(~ok).select("_line")


def read_edges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, skipped): the lines of an edge file, and those that are corrupt, of an unknown type or without an end."""
    rows = _lines(spark, path, EDGE)
    ok = F.coalesce(F.col("type").isin(*EDGE_TYPES) & F.col("from").isNotNull() & F.col("to").isNotNull(), F.lit(False))
    return rows.where(ok).drop("_line"), rows.where(~ok).select("_line")


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """The events of a usage file, read line by line in as many tasks as it has splits. A bad last line is a torn write and is dropped;
    any other bad line is MetricsParseError, a missing file MetricsNotFound. outcome defaults to success."""
    if not exists(spark, path):
        raise error("MetricsNotFound", path)
    rows = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", USAGE).alias("r"))
    bad = F.col("r.tool_name").isNull() | F.col("r.timestamp").isNull()
    wrong = rows.where(bad).select("value").limit(2).collect()
    if wrong:
        last = tail(spark, path, len(wrong[0].value.encode()) + 2).decode(errors="replace")
        if len(wrong) > 1 or last.rstrip("\r\n").split("\n")[-1] != wrong[0].value:
            raise error("MetricsParseError", path)
    return rows.where(~bad).select("r.*").na.fill({"outcome": "success"})


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, rows_per_task: int = 100_000) -> DataFrame:
    """A table of an SQLite file that all workers can reach, in ranges of its row ids; columns by name of the schema."""
    import sqlite3

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = spark.createDataFrame([], schema).schema
    target = to_arrow_schema(wanted)
    columns = ", ".join('"' + f.name.replace('"', '""') + '"' for f in wanted)
    source = '"' + table.replace('"', '""') + '"'
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {source}").fetchone()
    if low is None:
        return spark.createDataFrame([], schema)

    def run(batches):
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
            for b in batches:
                for first in b.column(0).to_pylist():
                    rows = con.execute(f"SELECT {columns} FROM {source} WHERE rowid >= ? AND rowid < ?", (first, first + rows_per_task)).fetchall()
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(target)], schema=target)

    n = (high - low) // rows_per_task + 1
    return spark.range(low, high + 1, rows_per_task, n).mapInArrow(run, wanted)


def read_backlogs(spark: SparkSession, folder: str) -> DataFrame:
    """Backlog documents backlog-*.json of a folder, in order of their id; malformed ones are left out."""
    schema = "id string, name string, title string, git_branch string, spec_path string, description string, status string"
    rows = spark.read.schema(schema + ", _corrupt string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "backlog-*.json").json(folder).cache()
    return rows.where("_corrupt is null and id is not null").drop("_corrupt").orderBy("id")


def read_features(spark: SparkSession, folder: str) -> DataFrame:
    """Spec folders NNN-name: number, name, title (first heading of spec.md), and the text of each of their documents."""
    names = ("spec", "plan", "tasks", "research", "quickstart")
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("value"), F.input_file_name().alias("p"))
    parts = raw.select(F.regexp_extract("p", r"/(\d{3})-([^/]+)/([^/]+)\.md$", 1).alias("number"), F.regexp_extract("p", r"/(\d{3})-([^/]+)/([^/]+)\.md$", 2).alias("name"), F.regexp_extract("p", r"/(\d{3})-([^/]+)/([^/]+)\.md$", 3).alias("doc"), "value")
    wide = parts.where("number <> ''").groupBy("number", "name").pivot("doc", list(names)).agg(F.first("value"))
    return wide.withColumn("title", F.nullif(F.regexp_extract("spec", r"(?m)^#+ +(.+?)\s*$", 1), F.lit(""))).orderBy("number")


@dataclass
class Registry:
    """Content sources with their status, and the ingestion bounds."""

    sources: list[dict] = field(default_factory=list)
    max_file_size_bytes: int = MAX_FILE_BYTES
    batch_size: int = 50


def read_registry(path: str, root: str) -> Registry:
    """The registry file; a source is active, missing (no such path), or error (outside the root, or listed before).

    RegistryParseFailed for what is no registry, RegistryValidationFailed for bounds outside 1..100 MiB and 1..500."""
    import yaml

    try:
        raw = yaml.safe_load(Path(path).read_text()) or {}
        out = Registry([dict(s) for s in raw.get("sources") or []], int(raw.get("max_file_size_bytes", MAX_FILE_BYTES)), int(raw.get("batch_size", 50)))
    except (OSError, ValueError, TypeError, AttributeError, yaml.YAMLError) as e:
        raise error("RegistryParseFailed", str(e)) from None
    if not 0 < out.max_file_size_bytes <= 100 << 20 or not 0 < out.batch_size <= 500:
        raise error("RegistryValidationFailed", "bounds")
    base, seen = Path(root).resolve(), set()
    for s in out.sources:
        at = (base / str(s.get("path", ""))).resolve()
        inside = at == base or base in at.parents
        s["status"] = "error" if not inside or ".." in Path(str(s.get("path", ""))).parts or at in seen else "active" if at.exists() else "missing"
        seen.add(at)
    return out


@dataclass
class Config:
    """Workspace settings."""

    batch_max_size: int = 100
    supported_languages: tuple[str, ...] = ("rust",)
    exclude_patterns: tuple[str, ...] = ()
    max_file_size_bytes: int = MAX_FILE_BYTES
    token_limit: int = text.TIER_TOKENS
    max_traversal_depth: int = 5
    max_traversal_nodes: int = 50
    query_timeout_ms: int = 5000
    query_row_limit: int = 1000
    policy_enabled: bool = False
    policy_unmatched: str = "deny"
    policy_rules: tuple[tuple, ...] = ()


def read_config(path: str) -> Config:
    """The settings file; defaults where it is missing or no TOML, ConfigInvalidValue for a batch size outside 1..1000."""
    out = Config()
    try:
        raw = tomllib.loads(Path(path).read_text())
    except (OSError, tomllib.TOMLDecodeError):
        return out
    graph, policy = raw.get("code_graph", {}), raw.get("policy", {})
    out.batch_max_size = raw.get("batch", {}).get("max_size", out.batch_max_size)
    if not 1 <= out.batch_max_size <= 1000:
        raise error("ConfigInvalidValue", "batch.max_size")
    for name in ("supported_languages", "exclude_patterns"):
        setattr(out, name, tuple(graph.get(name, getattr(out, name))))
    for name in ("max_file_size_bytes", "max_traversal_depth", "max_traversal_nodes"):
        setattr(out, name, graph.get(name, getattr(out, name)))
    out.token_limit = graph.get("embedding", {}).get("token_limit", out.token_limit)
    out.query_timeout_ms, out.query_row_limit = raw.get("query_timeout_ms", out.query_timeout_ms), raw.get("query_row_limit", out.query_row_limit)
    out.policy_enabled, out.policy_unmatched = policy.get("enabled", False), policy.get("unmatched", "deny")
    out.policy_rules = tuple((k, r["agent_role"], r.get("allow", []), r.get("deny", [])) for k, r in enumerate(policy.get("rules", [])))
    return out


COMMIT = "hash string, short_hash string, author_name string, author_email string, committed_at timestamp, message string, parent_hashes array<string>, changes array<struct<file_path string, change_type string, diff_snippet string, lines_added int, lines_removed int>>"


def _changes(block: str) -> list[tuple]:
    """The changes of one commit, from its raw lines and the patch below them."""
    from loomgraph.operators.commits import CHANGE_TYPES, DIFF_LINES

    raw, _, patch = block.partition("diff --git ")
    bodies = {}
    for part in ("\n" + patch).split("\ndiff --git ") if patch else []:
        hunks = part[part.find("\n@@") + 1 :].rstrip("\n").split("\n") if "\n@@" in part else []
        bodies[part.lstrip("\n").split("\n", 1)[0].rsplit(" b/", 1)[-1]] = hunks
    out = []
    for line in raw.split("\n"):
        if not line.startswith(":"):
            continue
        kind, *paths = line.split(" ", 4)[4].split("\t")
        lines = bodies.get(paths[-1], [])
        head = lines[:DIFF_LINES]
        snippet = "\n".join(head) + ("\n[diff truncated]\n" if len(lines) > DIFF_LINES else "")
        out.append((paths[-1], CHANGE_TYPES.get(kind[0], "modify"), snippet, sum(x.startswith("+") for x in head), sum(x.startswith("-") for x in head)))
    return out


def read_git(spark: SparkSession, root: str, depth: int = 500, stop_at: str | None = None) -> DataFrame:
    """Commits of a work tree, newest first, at most `depth`, up to a known hash; each with its changes against the first parent. One
    `git log` gives them all."""
    from datetime import datetime, timezone

    if depth < 1:
        raise error("InvalidParams", "depth")
    shown = "--format=%x1e%H%x1f%h%x1f%an%x1f%ae%x1f%ct%x1f%P%x1f%B%x1d"
    try:
        log = subprocess.run(["git", "-C", root, "log", f"-{depth}", "--date-order", "--root", "--diff-merges=first-parent", "-M", "--raw", "-p", shown], capture_output=True, text=True, errors="replace", check=True).stdout
    except FileNotFoundError:
        raise error("GitNotFound") from None
    except subprocess.CalledProcessError as e:
        raise error("GitAccessError", e.stderr.strip()) from None
    rows = []
    for record in log.split("\x1e")[1:]:
        about, _, block = record.partition("\x1d")
        h, short, name, mail, at, parents, message = about.split("\x1f")
        if h == stop_at:
            break
        rows.append((h, short, name, mail, datetime.fromtimestamp(int(at), timezone.utc), message.strip(), parents.split(), _changes(block)))
    return spark.createDataFrame(rows, COMMIT)
