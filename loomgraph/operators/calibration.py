"""Token use of plain file search against that of the tools, by purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The purposes, in report order.
PURPOSES = ("point_lookup", "neighborhood", "impact_trace", "broad_exploration", "implementation")


def tools_mentioned(response: Column) -> Column:
    """The search tools named in a response, in order."""
    return F.regexp_extract_all(response, F.lit(r"(?i)\b(?:functions\.)?(rg|glob|view)\b"), 1)


def baseline_records(sessions: DataFrame, turns: DataFrame, repository: str | None = None, since=None) -> DataFrame:
    """session_id, turn_index, timestamp, tools, estimated_tokens, purpose of the turns that name a search tool.

    sessions (session_id, repository, branch), turns (session_id, turn_index, timestamp, assistant_response)."""
    s = sessions.where(F.col("repository") == repository) if repository else sessions
    t = turns.where(F.col("timestamp") >= F.lit(since)) if since else turns
    named = tools_mentioned(F.col("assistant_response"))
    rows = t.join(s, "session_id").withColumn("tools", named).where(F.size("tools") > 0)
    each = F.greatest(F.ceil(F.length("assistant_response") / 12), F.lit(1))
    has = lambda x: F.exists("tools", lambda v: F.lower(v) == x)
    purpose = F.when(has("view"), "neighborhood").when(has("glob"), "broad_exploration").when(F.size("tools") >= 3, "impact_trace").otherwise("point_lookup")
    return rows.select(
        "session_id", "turn_index", "timestamp", F.coalesce(F.replace(F.nullif(F.trim("branch"), F.lit("")), F.lit("/"), F.lit("__")), F.lit("unknown")).alias("branch"), "tools", (each * F.size("tools")).alias("estimated_tokens"), purpose.alias("purpose")
    )


def purpose_of(tool: Column, results: Column) -> Column:
    """The purpose a tool call stands for."""
    return (
        F.when(tool == "list_symbols", "point_lookup")
        .when(tool == "impact_analysis", "impact_trace")
        .when(tool == "unified_search", "broad_exploration")
        .when((tool == "map_code") & (results <= 1), "point_lookup")
        .when(tool == "map_code", "neighborhood")
        .otherwise("implementation")
    )


def report(baseline: DataFrame, calls: DataFrame) -> DataFrame:
    """One row per purpose: medians, multiplier (0 where the tools' median is 0), samples and confidence; both sides have purpose, estimated_tokens."""
    spark = baseline.sparkSession
    side = lambda df, n: df.groupBy("purpose").agg(F.median("estimated_tokens").alias(f"{n}_median"), F.count("*").alias(f"{n}_samples"))
    rows = spark.createDataFrame([(p,) for p in PURPOSES], "purpose string").join(side(baseline, "baseline"), "purpose", "left").join(side(calls, "tool"), "purpose", "left").na.fill(0)
    least = F.least("baseline_samples", "tool_samples")
    return rows.select(
        "purpose",
        F.round("baseline_median", 2).alias("baseline_median"),
        F.round("tool_median", 2).alias("tool_median"),
        F.round(F.coalesce(F.try_divide(F.col("baseline_median"), F.nullif(F.col("tool_median"), F.lit(0.0))), F.lit(0.0)), 2).alias("multiplier"),
        "baseline_samples",
        "tool_samples",
        F.when(least < 10, "low").when(least <= 50, "medium").otherwise("high").alias("confidence"),
    )


def codebase(files: DataFrame) -> DataFrame:
    """One row of files (language, lines): primary language (most files, ties by name), total_files, total_loc, size_bracket."""
    per = files.groupBy("language").agg(F.count("*").alias("n"), F.sum("lines").alias("loc"))
    out = per.agg(F.max_by("language", F.struct("n", F.col("language"))).alias("language"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_files"), F.coalesce(F.sum("loc"), F.lit(0)).alias("total_loc"))
    return out.withColumn("size_bracket", F.when(F.col("total_loc") < 10_000, "small").when(F.col("total_loc") <= 100_000, "medium").otherwise("large"))
