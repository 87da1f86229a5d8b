"""Queries over commits and their changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.errors import error

LIMIT = 20
DIFF_LINES = 500

# Kinds of change by the letter of a diff; any other means modify.
CHANGE_TYPES = {"A": "add", "M": "modify", "D": "delete", "R": "rename"}


def parse_time(value: str | None):
    """A time in RFC 3339; InvalidParams for anything else."""
    from datetime import datetime, timezone

    if value is None:
        return None
    try:
        t = datetime.fromisoformat(value.replace("Z", "+00:00"))
    except ValueError:
        raise error("InvalidParams", f"not a time: {value!r}") from None
    return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t


def in_range(commits: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Commits from since to until, both included and both optional."""
    for bound, op in ((parse_time(since), "__ge__"), (parse_time(until), "__le__")):
        if bound is not None:
            commits = commits.where(getattr(F.col("committed_at"), op)(F.lit(bound).cast("timestamp_ntz")))
    return commits


def newest(commits: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The newest commits; limit 0 means the default."""
    return commits.orderBy(F.desc("committed_at"), "hash").limit(limit or LIMIT)


def touching(commits: DataFrame, path: str) -> DataFrame:
    """Commits that change a file."""
    return commits.where(F.exists("changes", lambda c: c["file_path"] == path))


def of_symbols(symbols: DataFrame, commits: DataFrame) -> DataFrame:
    """id, hash, committed_at: the commits that change the file of each symbol, by a join on the exploded changes."""
    changed = commits.select("hash", "committed_at", F.explode("changes").alias("c")).select("hash", "committed_at", F.col("c.file_path").alias("file_path")).distinct()
    return symbols.select("id", "file_path").join(changed, "file_path").select("id", "hash", "committed_at")


def latest_hash(commits: DataFrame) -> DataFrame:
    """One row, hash: that of the newest commit, ties by the greater hash; null without commits."""
    return commits.agg(F.max_by("hash", F.struct("committed_at", "hash")).alias("hash"))


def after_watermark(commits: DataFrame, known: DataFrame) -> DataFrame:
    """Commits newer than the newest known one: what an incremental run has to index; all if none is known."""
    mark = known.agg(F.max("committed_at").alias("mark"))
    return commits.join(mark, F.col("mark").isNull() | (F.col("committed_at") > F.col("mark"))).drop("mark")  # mark is one row


def change_totals(commits: DataFrame) -> DataFrame:
    """One row: commits, changes, lines added and removed."""
    lines = lambda f: F.aggregate(F.coalesce("changes", F.array().cast(commits.schema["changes"].dataType)), F.lit(0).cast("long"), lambda s, c: s + c[f])
    return commits.agg(F.count("*").alias("commits"), F.sum(F.coalesce(F.size("changes"), F.lit(0)).cast("long")).alias("changes"), F.sum(lines("lines_added")).alias("lines_added"), F.sum(lines("lines_removed")).alias("lines_removed"))


def changes_by_type(commits: DataFrame) -> DataFrame:
    """change_type, n, files, lines_added, lines_removed."""
    c = commits.select(F.explode("changes").alias("c")).select("c.*")
    return c.groupBy("change_type").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"), F.sum(F.col("lines_added").cast("long")).alias("lines_added"), F.sum(F.col("lines_removed").cast("long")).alias("lines_removed"))


def patch(diff: Column, most: int = DIFF_LINES) -> Column:
    """struct(snippet, lines_added, lines_removed) of a unified diff's text, its first `most` lines, with a marker where it was cut."""
    lines = F.split(diff, "\n")
    head = F.slice(lines, 1, most)
    starts = lambda p: F.size(F.filter(head, lambda x: F.startswith(x, F.lit(p)) & ~F.startswith(x, F.lit(p * 3))))
    text = F.when(F.size(lines) > most, F.concat(F.array_join(head, "\n"), F.lit("\n[diff truncated]\n"))).otherwise(diff)
    return F.struct(text.alias("snippet"), starts("+").alias("lines_added"), starts("-").alias("lines_removed"))
