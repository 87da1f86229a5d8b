"""Who may call which tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def role_of(params: Column) -> Column:
    """The caller's role in a call's JSON parameters, null without one."""
    return F.get_json_object(params, "$._meta.agent_role")


def decisions(calls: DataFrame, rules: DataFrame, enabled: bool = True, unmatched_allowed: bool = False) -> DataFrame:
    """calls with `allowed`. rules (place, agent_role, allow, deny): the first of a role counts, deny before allow, and a non-empty
    allow list excludes all else. Calls without a rule follow unmatched_allowed; all are allowed when not enabled."""
    if not enabled:
        return calls.withColumn("allowed", F.lit(True))
    first = rules.groupBy("agent_role").agg(F.min_by(F.struct("allow", "deny"), "place").alias("rule"))
    c = calls.join(first, "agent_role", "left")
    allow, deny = F.col("rule.allow"), F.col("rule.deny")
    ok = F.when(F.col("rule").isNull(), F.lit(unmatched_allowed)).when(F.array_contains(deny, F.col("tool_name")), F.lit(False)).when((F.size(allow) > 0) & ~F.array_contains(allow, F.col("tool_name")), F.lit(False)).otherwise(F.lit(True))
    return c.withColumn("allowed", ok).drop("rule")
