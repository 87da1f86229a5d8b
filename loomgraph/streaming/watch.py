"""Streams of file changes and usage events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.sources.files import USAGE

DEBOUNCE = "500 milliseconds"
QUIET = "2 seconds"
LATE = "10 minutes"

# Extensions whose change means a new index of the file.
CODE_EXTENSIONS = ("rs", "toml")

CHANGE = "path string, old_path string, kind string, timestamp timestamp"


def changes(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """File-change events from JSON files that a watcher drops into a folder."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def relevant(events: DataFrame) -> DataFrame:
    """Events of known kinds outside excluded directories; a rename into one of them is a deletion, one out of them a creation."""
    e = events.where(F.col("kind").isin("created", "modified", "deleted", "renamed"))
    out_new, out_old = text.is_excluded(F.col("path")), F.coalesce(text.is_excluded(F.col("old_path")), F.lit(False))
    renamed = F.col("kind") == "renamed"
    kind = F.when(renamed & out_new & ~out_old, "deleted").when(renamed & ~out_new & out_old, "created").otherwise(F.col("kind"))
    path = F.when(renamed & out_new & ~out_old, F.col("old_path")).otherwise(F.col("path"))
    old = F.when(kind == "renamed", F.col("old_path"))
    return e.where(~(out_new & (out_old | ~renamed))).select(path.alias("path"), old.alias("old_path"), kind.alias("kind"), "timestamp")


def action(path: Column, kind: Column) -> Column:
    """reindex for a created or modified file of CODE_EXTENSIONS, else skip."""
    ext = F.when(F.contains(path, F.lit(".")), F.substring_index(path, ".", -1))
    return F.when(kind.isin("created", "modified") & ext.isin(*CODE_EXTENSIONS), F.lit("reindex")).otherwise(F.lit("skip"))


def debounced(events: DataFrame, gap: str = DEBOUNCE, late: str = LATE) -> DataFrame:
    """path, kind, first_at, last_at, events: bursts of one path's events no more than `gap` apart, as their last event's kind.

    On a stream, events more than `late` behind the newest are dropped, so that state stays bounded."""
    e = events.withWatermark("timestamp", late) if events.isStreaming else events
    w = e.groupBy("path", F.session_window("timestamp", gap).alias("w")).agg(F.max_by("kind", "timestamp").alias("kind"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"), F.count("*").alias("events"))
    return w.select("path", "kind", "first_at", "last_at", "events")


def bursts(events: DataFrame, gap: str = QUIET, late: str = LATE, key: str | None = None) -> DataFrame:
    """first_at, last_at, events: all events until more than `gap` passes without one, of each value of `key` if there is one; each burst
    calls for one synchronisation.

    A table is first counted by slots of `gap`, two of which can only part where the pause between them is long enough, so that
    only occupied slots are put in order. A stream does it by session windows, with bounded state."""
    keys = [key] if key else []
    if events.isStreaming:
        w = events.withWatermark("timestamp", late).groupBy(*keys, F.session_window("timestamp", gap).alias("w")).agg(F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"), F.count("*").alias("events"))
        return w.select(*keys, "first_at", "last_at", "events")
    # Within a slot two neighbours are less than `gap` apart.
    slots = events.where("timestamp is not null").groupBy(*keys, F.window(F.col("timestamp").cast("timestamp"), gap).alias("w")).agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"), F.count("*").alias("n"))
    by = Window.partitionBy(*keys).orderBy("a")
    fresh = F.coalesce(F.col("a") > F.lag("b").over(by) + F.expr(f"interval {gap}"), F.lit(True)).cast("long")
    w = slots.withColumn("fresh", fresh).withColumn("burst", F.sum("fresh").over(by)).groupBy(*keys, "burst").agg(F.min("a").alias("first_at"), F.max("b").alias("last_at"), F.sum("n").alias("events"))
    return w.select(*keys, "first_at", "last_at", "events")


def usage(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Usage events from JSON-lines files; torn or corrupt lines are dropped, outcome defaults to success."""
    raw = spark.readStream.schema(USAGE).option("maxFilesPerTrigger", files_per_trigger).option("mode", "PERMISSIVE").json(folder)
    return raw.where("tool_name is not null and timestamp is not null").na.fill({"outcome": "success"})


def windowed_usage(events: DataFrame, width: str = "10 minutes", late: str | None = LATE) -> DataFrame:
    """tool_name, starts_at, calls, tokens per time window; late None keeps all windows open, for sources that end."""
    e = events.withColumn("at", F.to_timestamp("timestamp"))
    e = e.withWatermark("at", late) if e.isStreaming and late else e
    w = e.groupBy("tool_name", F.window("at", width).alias("w")).agg(F.count("*").alias("calls"), F.sum("estimated_tokens").alias("tokens"))
    return w.select("tool_name", F.col("w.start").alias("starts_at"), "calls", "tokens")


def write_usage(events: DataFrame, folder: str, checkpoint: str):
    """Start the sink of usage events: JSON lines below a folder per branch, each event once, until the source is drained."""
    named = events.withColumn("branch_dir", F.replace(F.coalesce("branch", F.lit("unknown")), F.lit("/"), F.lit("__")))
    return named.writeStream.partitionBy("branch_dir").format("json").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def on_each_burst(events: DataFrame, synchronise: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a stream that hands each batch's distinct paths to reindex to `synchronise(paths, batch id)`."""

    def batch(df: DataFrame, number: int) -> None:
        paths = df.where(action(F.col("path"), F.col("kind")) == "reindex").select("path").distinct()
        if not paths.isEmpty():
            synchronise(paths, number)

    return relevant(events).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


IDLE_MINUTES = 240


def idle(events: DataFrame, minutes: int = IDLE_MINUTES, key: str = "workspace", late: str = LATE, now: Column | None = None) -> DataFrame:
    """key, last_at, idle_at: since when a workspace has been idle, that is `minutes` after its last event; 0 minutes is never.

    Of a table: as it stands at `now`, the current time without it. On a stream: each time a pause of that length has passed."""
    if minutes <= 0:
        return events.select(key, F.col("timestamp").alias("last_at"), F.col("timestamp").alias("idle_at")).where(F.lit(False))
    ttl = F.expr(f"interval {minutes} minutes")
    if events.isStreaming:
        e = events.withWatermark("timestamp", late)
        w = e.groupBy(key, F.session_window("timestamp", f"{minutes} minutes").alias("w")).agg(F.max("timestamp").alias("last_at"))
        return w.select(key, "last_at", (F.col("last_at") + ttl).alias("idle_at"))
    last = events.groupBy(key).agg(F.max("timestamp").alias("last_at")).withColumn("idle_at", F.col("last_at") + ttl)
    return last.where(F.col("idle_at") <= (now if now is not None else F.current_timestamp()))
