import time
from datetime import datetime, timedelta

from loomgraph.operators import calibration, policy, telemetry

U = "event_id long, tool_name string, timestamp timestamp_ntz, estimated_tokens long, results_returned long, branch string, connection_id string, agent_role string, outcome string, elapsed_ms double"
T0 = datetime(2025, 1, 1)


def events(spark, *rows):
    base = dict(tool_name="a", at=0, tokens=0, results=0, branch="main", conn="1", role=None, outcome="success", ms=1.0)
    full = [base | r for r in rows]
    return spark.createDataFrame([(i, r["tool_name"], T0 + timedelta(seconds=r["at"]), r["tokens"], r["results"], r["branch"], r["conn"], r["role"], r["outcome"], float(r["ms"])) for i, r in enumerate(full)], U)


def test_summary(spark):
    e = events(spark, *[dict(tokens=t, tool_name=n) for t, n in ((250, "a"), (500, "b"), (125, "a"), (375, "a"), (75, "b"))])
    t = telemetry.totals(e).first()
    assert (t.total_tool_calls, t.total_tokens, t.session_count) == (5, 1325, 1)
    assert {r.tool_name: (r.call_count, r.avg_tokens) for r in telemetry.by_tool(e).collect()} == {"a": (3, 250.0), "b": (2, 287.5)}
    assert [r.tool_name for r in telemetry.top_tools(e).collect()] == ["a", "b"]
    assert telemetry.totals(e.limit(0)).first().total_tokens == 0
    assert telemetry.token_report(e).first().report == "Calls: 5; tokens: 1325; per call: 265.00; top: a (3), b (2)"


def test_branches(spark):
    e = events(spark, dict(branch="x", tokens=5), dict(branch="y", tokens=9), dict(branch="y"))
    r = telemetry.compare_branches(e, "x", "y").first()
    assert (r.calls, r.other_calls, r.delta_calls, r.delta_tokens) == (1, 2, 0, 0)


def test_efficiency(spark):
    a = telemetry.efficiency(events(spark, dict(tokens=10000, results=1), dict(role="r", outcome="error"), dict(role="r", outcome="error")))
    got = {r.agent_role: r for r in a.collect()}
    assert got["anonymous"].tokens_per_result == 10000 and got["r"].tokens_per_result == 0.0 and got["r"].error_rate == 1.0
    odd = {(r.anomaly_type, r.agent_role) for r in telemetry.anomalies(a, telemetry.hammering(events(spark, {}))).collect()}
    assert odd == {("token_ratio_spike", "anonymous"), ("error_burst", "r")}
    # 0.4 * 0 + 0.3 + 0.075 + 0.15 and 0.4 + 0 + 0.075 + 0.15 for one call and two
    assert telemetry.overall_score(a).first().efficiency_score == 59
    assert telemetry.overall_score(telemetry.efficiency(events(spark, {}).limit(0))).first().efficiency_score == 0


def test_hammering(spark):
    close = events(spark, *[dict(at=i) for i in range(25)])
    apart = events(spark, *[dict(at=i * 4) for i in range(25)])
    assert [(r.agent_role, r.tool_name) for r in telemetry.hammering(close).collect()] == [("anonymous", "a")]
    assert telemetry.hammering(apart).count() == 0
    assert telemetry.hammering(events(spark, *[dict(at=i * 3) for i in range(21)])).count() == 1


def test_hammering_long_and_busy(spark):
    """A month of calls, one a second: the time does not grow with the square of the calls in `seconds`."""
    e = spark.range(150_000).selectExpr("'r' as agent_role", "if(id % 1000 = 0, null, 'a') as tool_name", "timestamp_seconds(id - 5000) as timestamp")
    began = time.monotonic()
    assert [tuple(x) for x in telemetry.hammering(e, 30 * 86_400).collect()] == [("r", "a")]
    assert [tuple(x) for x in telemetry.hammering(e.where("tool_name is null"), 30 * 86_400).collect()] == [("r", None)]
    assert telemetry.hammering(e, 30 * 86_400, 150_000).count() == 0
    # 149,850 calls over 149,998 seconds, on both sides of the slot's end at 1970-01-01
    assert telemetry.hammering(e, 149_998, 149_850).count() == 1 and telemetry.hammering(e, 149_997, 149_850).count() == 0
    assert time.monotonic() - began < 90


def test_timing(spark):
    e = events(spark, *[dict(ms=m) for m in [10] * 9 + [100]])
    r = telemetry.query_timing(e).first()
    assert (r.total, r.slow_count, r.avg_ms, r.p95_ms) == (10, 1, 19.0, 100.0)
    p = telemetry.latency_percentiles(events(spark, *[dict(ms=m) for m in range(1, 101)])).first()
    assert (p.p50, p.p95, p.p99) == (51.0, 96.0, 100.0)


def test_rate_limit(spark):
    e = events(spark, *[dict(at=i) for i in range(5)], dict(at=61))
    got = {r.event_id: r.accepted for r in telemetry.rate_limited(e, 2, 60).collect()}
    assert [got[i] for i in range(6)] == [True, True, False, False, False, True]
    assert [r.event_id for r in telemetry.recent(e, 2).collect()] == [5, 4]
    assert {r.event_id: r.calls for r in telemetry.rolling_rate(e, 2).collect()}[4] == 3


def test_policy(spark):
    rules = spark.createDataFrame([(0, "dev", ["a", "b"], ["b"]), (1, "free", [], ["z"]), (2, "dev", [], [])], "place int, agent_role string, allow array<string>, deny array<string>")
    calls = spark.createDataFrame([("dev", "a"), ("dev", "b"), ("dev", "c"), ("free", "a"), ("free", "z"), (None, "a"), ("other", "a")], "agent_role string, tool_name string")
    got = {(r.agent_role, r.tool_name): r.allowed for r in policy.decisions(calls, rules).collect()}
    assert got == {("dev", "a"): True, ("dev", "b"): False, ("dev", "c"): False, ("free", "a"): True, ("free", "z"): False, (None, "a"): False, ("other", "a"): False}
    assert all(r.allowed for r in policy.decisions(calls, rules, enabled=False).collect())
    assert {r.agent_role for r in policy.decisions(calls, rules, unmatched_allowed=True).where("allowed").collect()} >= {None, "other"}


def test_calibration(spark):
    sessions = spark.createDataFrame([("s", "repo", "feature/x"), ("t", "repo", None)], "session_id string, repository string, branch string")
    turns = spark.createDataFrame([("s", 1, T0, "used functions.rg and view"), ("s", 2, T0, "rg rg rg"), ("t", 1, T0, "nothing"), ("t", 2, T0, "RG once"), ("t", 3, T0, None)], "session_id string, turn_index int, timestamp timestamp_ntz, assistant_response string")
    got = {(r.session_id, r.turn_index): (r.purpose, r.branch, len(r.tools)) for r in calibration.baseline_records(sessions, turns).collect()}
    assert got == {("s", 1): ("neighborhood", "feature__x", 2), ("s", 2): ("impact_trace", "feature__x", 3), ("t", 2): ("point_lookup", "unknown", 1)}
    side = "purpose string, estimated_tokens long"
    base = spark.createDataFrame([("point_lookup", 400), ("point_lookup", 800), ("impact_trace", 2000)], side)
    tool = spark.createDataFrame([("point_lookup", 100), ("point_lookup", 200), ("impact_trace", 500)], side)
    rep = {r.purpose: r for r in calibration.report(base, tool).collect()}
    assert rep["point_lookup"].multiplier == 4.0 and rep["impact_trace"].confidence == "low" and rep["implementation"].multiplier == 0.0 and len(rep) == 5


def test_slots_against_plain_rules(spark):
    """Rates, hammering, percentiles and limits by slots and brackets, against loops over all events."""
    import random

    r = random.Random(5)
    rows, at = [], 0
    for _ in range(600):
        at += r.choice([0, 0, 1, 1, 2, 5, 30, 60, 61, 200])
        rows.append(dict(at=at, conn=r.choice("xyz"), tool_name=r.choice("ab"), role=r.choice(["r", None]), ms=r.choice([1, 2, 2, 3, r.random() * 100])))
    e = events(spark, *rows)
    near = lambda i, s: sum(q["conn"] == rows[i]["conn"] and 0 <= rows[i]["at"] - q["at"] <= s for q in rows)
    assert {x.event_id: x.calls for x in telemetry.rolling_rate(e, 60).collect()} == {i: near(i, 60) for i in range(len(rows))}
    held, want = {}, {}
    for i, q in enumerate(rows):
        own = [t for t in held.get(q["conn"], []) if t > q["at"] - 60]
        want[i] = len(own) < 3
        held[q["conn"]] = own + [q["at"]] * want[i]
    assert {x.event_id: x.accepted for x in telemetry.rate_limited(e, 3, 60).collect()} == want
    for calls in (3, 6, 40):
        hit = {}
        for role in ("r", "anonymous"):
            for tool in "ab":
                t = sorted(q["at"] for q in rows if (q["role"] or "anonymous") == role and q["tool_name"] == tool)
                if any(b - a <= 60 for a, b in zip(t, t[calls - 1 :])):
                    hit.setdefault(role, tool)
        assert {x.agent_role: x.tool_name for x in telemetry.hammering(e, 60, calls).collect()} == hit
    for x in telemetry.latency_percentiles(e).collect():
        v = sorted(float(q["ms"]) for q in rows if q["tool_name"] == x.tool_name)
        assert (x.p50, x.p95, x.p99) == tuple(v[min(len(v) * p // 100, len(v) - 1)] for p in (50, 95, 99))
    assert telemetry.latency_percentiles(e.limit(0)).count() == 0 and telemetry.rate_limited(e.limit(0)).count() == 0
    odd = e.limit(2).selectExpr("event_id", "tool_name", "cast(null as timestamp_ntz) as timestamp", "cast(null as string) as connection_id")
    assert [x.calls for x in telemetry.rolling_rate(odd).collect()] == [2, 2] and not any(x.accepted for x in telemetry.rate_limited(odd).collect())
