"""Usage summaries, agent efficiency, anomalies and latency figures over usage events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOP_TOOLS = 10
REPORT_TOOLS = 5
HAMMER_CALLS, HAMMER_SECONDS = 21, 60
RING, SAMPLES = 256, 1000
SLOW_MS = 100
RATE_CALLS, RATE_SECONDS = 20, 60

# Weights of token efficiency, errors, diversity and latency, and the thresholds of the evaluation.
WEIGHTS = (0.4, 0.3, 0.15, 0.15)
MAX_TOKEN_RATIO, MAX_ERROR_RATE, MIN_TOOLS, TOKEN_CEILING = 10.0, 0.3, 2, 1000.0


def by_tool(events: DataFrame) -> DataFrame:
    """tool_name, call_count, total_tokens, avg_tokens (half away from zero, two digits)."""
    return events.groupBy("tool_name").agg(F.count("*").alias("call_count"), F.sum("estimated_tokens").alias("total_tokens")).withColumn("avg_tokens", F.round(F.col("total_tokens") / F.col("call_count"), 2))


def totals(events: DataFrame) -> DataFrame:
    """One row: total_tool_calls, total_tokens, first and last time, session_count; zeros and nulls without events."""
    return events.agg(
        F.count("*").alias("total_tool_calls"),
        F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("total_tokens"),
        F.min("timestamp").alias("first_at"),
        F.max("timestamp").alias("last_at"),
        F.countDistinct("connection_id").alias("session_count"),
    )


def top_tools(events: DataFrame, limit: int = TOP_TOOLS) -> DataFrame:
    """tool_name, count of the most called tools, ties by name."""
    return events.groupBy("tool_name").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "tool_name").limit(limit)


def compare_branches(events: DataFrame, one: str, other: str) -> DataFrame:
    """One row: calls and tokens of two branches and what the first has more, never below 0."""
    mine = lambda b: F.col("branch") == b
    sums = events.agg(
        F.count_if(mine(one)).alias("calls"),
        F.coalesce(F.sum(F.when(mine(one), F.col("estimated_tokens"))), F.lit(0)).alias("tokens"),
        F.count_if(mine(other)).alias("other_calls"),
        F.coalesce(F.sum(F.when(mine(other), F.col("estimated_tokens"))), F.lit(0)).alias("other_tokens"),
    )
    return sums.select("*", F.greatest(F.col("calls") - F.col("other_calls"), F.lit(0)).alias("delta_calls"), F.greatest(F.col("tokens") - F.col("other_tokens"), F.lit(0)).alias("delta_tokens"))


def token_report(events: DataFrame) -> DataFrame:
    """branch, report: the text of calls, tokens, the mean per call and the five most called tools of each branch."""
    per = events.groupBy("branch", "tool_name").agg(F.count("*").alias("n"), F.sum("estimated_tokens").alias("t"))
    rows = per.groupBy("branch").agg(F.sum("n").alias("calls"), F.sum("t").alias("tokens"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("tool_name").alias("tool")))).alias("tools"))
    tools = F.array_join(F.transform(F.slice("tools", 1, REPORT_TOOLS), lambda x: F.concat(x["tool"], F.lit(" ("), (-x["n"]).cast("string"), F.lit(")"))), ", ")
    mean = F.format_string("%.2f", F.round(F.col("tokens") / F.col("calls"), 2))
    text = F.concat(F.lit("Calls: "), F.col("calls").cast("string"), F.lit("; tokens: "), F.col("tokens").cast("string"), F.lit("; per call: "), mean, F.lit("; top: "), tools)
    return rows.select("branch", text.alias("report"))


def efficiency(events: DataFrame) -> DataFrame:
    """Per agent_role (anonymous for null): total_calls, total_tokens, total_results, avg_tokens_per_call, tokens_per_result (0 without
    results), error_rate, tool_diversity."""
    per = events.groupBy(F.coalesce("agent_role", F.lit("anonymous")).alias("agent_role")).agg(
        F.count("*").alias("total_calls"),
        F.sum("estimated_tokens").alias("total_tokens"),
        F.sum("results_returned").alias("total_results"),
        F.count_if(F.col("outcome") != "success").alias("errors"),
        F.countDistinct("tool_name").alias("tool_diversity"),
    )
    return per.select(
        "agent_role",
        "total_calls",
        "total_tokens",
        "total_results",
        (F.col("total_tokens") / F.col("total_calls")).alias("avg_tokens_per_call"),
        F.coalesce(F.try_divide(F.col("total_tokens"), F.col("total_results")), F.lit(0.0)).alias("tokens_per_result"),
        (F.col("errors") / F.col("total_calls")).alias("error_rate"),
        "tool_diversity",
    )


def agent_score() -> Column:
    """The score of a row of efficiency(), 0..1; latency has full marks as there are no figures for it."""
    token, error, diversity, latency = WEIGHTS
    return (
        token * (1.0 - F.least(F.col("tokens_per_result") / TOKEN_CEILING, F.lit(1.0)))
        + error * (1.0 - F.col("error_rate"))
        + diversity * F.least(F.col("tool_diversity") / float(max(MIN_TOOLS, 1)), F.lit(1.0))
        + latency
    )


def overall_score(agents: DataFrame) -> DataFrame:
    """efficiency_score: 100 times the mean of the agents' scores, weighed by calls; 0 without agents."""
    mean = F.sum(agent_score() * F.col("total_calls")) / F.greatest(F.sum("total_calls"), F.lit(1))
    return agents.agg(F.coalesce(F.least(F.greatest(F.round(mean * 100, 0), F.lit(0.0)), F.lit(100.0)), F.lit(0.0)).cast("int").alias("efficiency_score"))


def hammering(events: DataFrame, seconds: int = HAMMER_SECONDS, calls: int = HAMMER_CALLS) -> DataFrame:
    """agent_role, tool_name: the first tool by name that a role called `calls` times within `seconds` (whole epoch seconds).

    Calls are counted by slots of `seconds` first. A slot of `calls` is a hit as it stands. Otherwise only two slots in
    succession can make one, if they hold `calls` together: fewer than 2 x `calls` times, whatever the table's size and `seconds`, and
    these alone are looked at one by one. So no role, tool or slot is one task, and no sum is made anew for each call."""
    at = F.unix_timestamp(F.col("timestamp").cast("timestamp"))
    e = events.select(F.coalesce("agent_role", F.lit("anonymous")).alias("agent_role"), "tool_name", at.alias("at")).where("at is not null")
    slot = F.floor(F.col("at") / seconds)
    counted = e.groupBy("agent_role", "tool_name", slot.alias("slot")).agg(F.count("*").alias("n"))
    full, thin = counted.where(F.col("n") >= calls), counted.where(F.col("n") < calls)
    ends = thin.select("agent_role", "tool_name", "n", F.explode(F.array("slot", F.col("slot") + 1)).alias("end"))
    twos = ends.groupBy("agent_role", "tool_name", "end").agg(F.sum("n").alias("n")).where(F.col("n") >= calls)
    look = twos.select(F.col("agent_role").alias("role"), F.col("tool_name").alias("tool"), "end", F.explode(F.array("end", F.col("end") - 1)).alias("in"))
    near = e.join(look, (F.col("agent_role") == F.col("role")) & F.col("tool_name").eqNullSafe(F.col("tool")) & (slot == F.col("in")))
    times = near.groupBy("agent_role", "tool_name", "end").agg(F.sort_array(F.collect_list("at")).alias("times"))
    close = F.exists(F.sequence(F.lit(0), F.size("times") - calls), lambda i: F.col("times")[i + calls - 1] - F.col("times")[i] <= seconds)
    hit = full.select("agent_role", "tool_name").unionByName(times.where(close).select("agent_role", "tool_name"))
    return hit.groupBy("agent_role").agg(F.min("tool_name").alias("tool_name"))


def anomalies(agents: DataFrame, hammered: DataFrame) -> DataFrame:
    """anomaly_type, severity, agent_role, description of token_ratio_spike, error_burst and tool_hammering."""
    role, tpr, err = F.col("agent_role"), F.col("tokens_per_result"), F.col("error_rate")
    spike = agents.where(tpr > MAX_TOKEN_RATIO).select(
        F.lit("token_ratio_spike").alias("anomaly_type"), F.lit("warning").alias("severity"), role, F.format_string(f"Agent '%s' tokens-per-result %.1f exceeds threshold {MAX_TOKEN_RATIO:.1f}", role, tpr).alias("description")
    )
    burst = agents.where(err > MAX_ERROR_RATE).select(
        F.lit("error_burst").alias("anomaly_type"), F.lit("critical").alias("severity"), role, F.format_string(f"Agent '%s' error rate %.0f%% exceeds threshold {MAX_ERROR_RATE * 100:.0f}%%", role, err * 100).alias("description")
    )
    hammer = hammered.select(
        F.lit("tool_hammering").alias("anomaly_type"), F.lit("warning").alias("severity"), role, F.format_string(f"Agent '%s' called '%s' {HAMMER_CALLS} times within {HAMMER_SECONDS} seconds", role, F.col("tool_name")).alias("description")
    )
    return spike.unionByName(burst).unionByName(hammer)


def recommendations(agents: DataFrame, found: DataFrame) -> DataFrame:
    """kind, agent_role of what the report advises: more tools for a role of fewer than MIN_TOOLS, and what the anomalies call for."""
    few = agents.where(F.col("tool_diversity") < MIN_TOOLS).select(F.lit("use_more_tools").alias("kind"), "agent_role")
    kind = F.when(F.col("anomaly_type") == "token_ratio_spike", F.lit("use_targeted_lookups")).when(F.col("anomaly_type") == "tool_hammering", F.lit("cache_results"))
    session = found.select(kind.alias("kind"), F.lit(None).cast("string").alias("agent_role")).where("kind is not null").distinct()
    return few.unionByName(session)


#: percentile_approx is off by a rank of 1 / ACCURACY of the rows at most; brackets are SLACK times as wide on either side.
ACCURACY, SLACK = 10_000, 5


def at_ranks(rows: DataFrame, group: str, value: str, ranks: dict[str, tuple[float, Column]]) -> DataFrame:
    """group, n, and for each name of `ranks` the value at a place, from 0, of the group's sorted values; ranks: the share of the rows
    near which the place lies, and the place as an expression over n. Null values are left out.

    Exact, and no group is sorted in one task: approximate percentiles bracket each place, what lies below a bracket is counted,
    and only the distinct values inside it, some thousandth of the group, are ranked."""
    rows = rows.where(F.col(value).isNotNull()).select(F.col(group), F.col(value).alias("v"))
    shares = [min(max(share + side * SLACK / ACCURACY, 0.0), 1.0) for share, _ in ranks.values() for side in (-1, 1)]
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"), F.percentile_approx("v", shares, ACCURACY).alias("cuts"))
    cut = rows.join(sizes, group)
    inside = [F.when((F.col("v") >= F.col("cuts")[2 * k]) & (F.col("v") <= F.col("cuts")[2 * k + 1]), F.lit(k)) for k in range(len(ranks))]
    below = [F.count_if(F.col("v") < F.col("cuts")[2 * k]).alias(f"below_{k}") for k in range(len(ranks))]
    lower = cut.groupBy(group).agg(F.first("n").alias("n"), *below)
    marked = cut.select(group, "v", F.explode(F.filter(F.array(*inside), lambda k: k.isNotNull())).alias("k")).groupBy(group, "k", "v").agg(F.count("*").alias("m"))
    places = F.array(*[place.cast("long") - F.col(f"below_{k}") for k, (_, place) in enumerate(ranks.values())])
    upto = F.sum("m").over(W.partitionBy(group, "k").orderBy("v"))
    found = marked.withColumn("upto", upto).join(lower.select(group, "n", places.alias("places")), group).where(F.col("upto") > F.col("places")[F.col("k")])
    picked = [F.min(F.when(F.col("k") == k, F.col("v"))).alias(name) for k, name in enumerate(ranks)]
    return found.groupBy(group).agg(F.first("n").alias("n"), *picked)


def latency_percentiles(events: DataFrame) -> DataFrame:
    """tool_name, p50, p95, p99: of n sorted samples that at place floor(n * p / 100), from 0."""
    place = lambda p: F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1)
    return at_ranks(events, "tool_name", "elapsed_ms", {f"p{p}": (p / 100, place(p)) for p in (50, 95, 99)}).select("tool_name", "p50", "p95", "p99")


def query_timing(events: DataFrame) -> DataFrame:
    """tool_name, total, slow_count (SLOW_MS or more), avg_ms, p95_ms (nearest rank)."""
    nearest = at_ranks(events, "tool_name", "elapsed_ms", {"p95_ms": (0.95, F.ceil(F.col("n") * 95 / 100) - 1)}).select("tool_name", "p95_ms")
    sums = events.where("elapsed_ms is not null").groupBy("tool_name").agg(F.count("*").alias("total"), F.count_if(F.col("elapsed_ms") >= SLOW_MS).alias("slow_count"), F.round(F.avg("elapsed_ms"), 6).alias("avg_ms"))
    return sums.join(nearest, "tool_name").select("tool_name", "total", "slow_count", "avg_ms", "p95_ms")


def recent(events: DataFrame, keep: int = RING) -> DataFrame:
    """The last `keep` events."""
    return events.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(keep)


def recent_samples(events: DataFrame, keep: int = SAMPLES) -> DataFrame:
    """The last `keep` samples of each tool."""
    by = W.partitionBy("tool_name").orderBy(F.desc("timestamp"), F.desc("event_id"))
    return events.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= keep).drop("_r")


def rolling_rate(events: DataFrame, seconds: int = RATE_SECONDS) -> DataFrame:
    """event_id, calls: how many calls of its connection lie in the `seconds` up to each event.

    Calls are counted by second, and each second stands in its own slot of `seconds` and in the next, so that a slot holds all its
    calls are counted with, and a busy connection is many tasks."""
    at = F.unix_timestamp(F.col("timestamp").cast("timestamp"))
    slim = events.select("event_id", "connection_id", at.alias("at"))
    slot = F.floor(F.col("at") / seconds)
    counted = slim.groupBy("connection_id", "at").agg(F.count("*").alias("n"))
    slots = counted.withColumn("slot", F.explode(F.when(F.col("at").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(slot, slot + 1))))
    by = W.partitionBy("connection_id", "slot").orderBy("at").rangeBetween(-seconds, 0)
    own = slots.withColumn("calls", F.sum("n").over(by)).where(F.col("slot").eqNullSafe(slot)).select(F.col("connection_id").alias("c"), F.col("at").alias("second"), "calls")
    return slim.join(own, F.col("connection_id").eqNullSafe(F.col("c")) & F.col("at").eqNullSafe(F.col("second"))).select("event_id", "calls")


def rate_limited(events: DataFrame, calls: int = RATE_CALLS, seconds: int = RATE_SECONDS) -> DataFrame:
    """event_id, accepted: a connection's attempt is accepted while fewer than `calls` accepted ones lie in the last `seconds`;
    rejected attempts do not count.

    The verdict feeds back, so attempts are passed in order, but only as far as they can matter: after a pause of `seconds` a
    connection begins anew, so stretches between pauses are told apart by the occupied slots of time, and each is a stream
    of its own, of which a task holds no more than the last `calls` accepted times. Events without a time are not accepted."""
    from collections import deque

    import pyarrow as pa

    def run(batches):
        now, held = None, deque()
        for b in batches:
            out = []
            for stretch, t in zip(zip(b.column(1).to_pylist(), b.column(2).to_pylist()), b.column(3).to_pylist()):
                if stretch != now:
                    now, held = stretch, deque()
                while held and t is not None and held[0] <= t - seconds * 1_000_000:
                    held.popleft()
                ok = t is not None and len(held) < calls
                if ok:
                    held.append(t)
                out.append(ok)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.bool_())], ["event_id", "accepted"])

    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    slim = events.select("event_id", F.coalesce("connection_id", F.lit("")).alias("connection"), at.alias("at"), F.floor(at / (seconds * 1_000_000)).alias("slot"))
    slots = slim.select("connection", "slot").distinct()
    by = W.partitionBy("connection").orderBy("slot")
    fresh = F.coalesce(F.col("slot") - F.lag("slot").over(by) > 1, F.lit(True)).cast("long")
    stretches = slots.withColumn("fresh", fresh).withColumn("stretch", F.sum("fresh").over(by)).select("connection", "slot", "stretch")
    placed = slim.join(stretches.withColumnRenamed("slot", "s").withColumnRenamed("connection", "c"), (F.col("connection") == F.col("c")) & F.col("slot").eqNullSafe(F.col("s"))).select("event_id", "connection", "stretch", "at")
    ordered = placed.repartition("connection", "stretch").sortWithinPartitions("connection", "stretch", "at", "event_id")
    return ordered.mapInArrow(run, "event_id long, accepted boolean")
