"""Read-only ad-hoc queries: a lexical check, an allow-list over the parsed plan, a row limit and a time limit.

Nothing of a query is analysed or run before every node of its parsed plan is known to read only: relations are views of the
caller's, by name, so no path or catalogue table can be named; functions are built in, and none that calls into the JVM or
fails on purpose; table functions only make rows of their arguments.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from loomgraph.errors import error

ROW_LIMIT, TIMEOUT_MS = 1000, 5000

# Words that no read-only query has outside its literals.
WRITE_WORDS = ("INSERT", "UPDATE", "DELETE", "CREATE", "DEFINE", "REMOVE", "RELATE", "KILL", "SLEEP", "THROW", "UPSERT", "ALTER", "REBUILD")

_LITERAL = re.compile(r"""'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*\"""", re.S)
_WORD = re.compile(r"(?<![A-Za-z0-9_])(" + "|".join(WRITE_WORDS) + r")(?![A-Za-z0-9_])", re.I)

#: Nodes of a parsed plan that only read.
NODES = frozenset(
    "Project Filter Aggregate Sort Distinct Deduplicate GlobalLimit LocalLimit Offset Join LateralJoin Union Except Intersect SubqueryAlias OneRowRelation LocalRelation Window WithWindowDefinition Generate Pivot Unpivot Sample "
    "UnresolvedRelation UnresolvedWith UnresolvedHaving UnresolvedInlineTable UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedTVFAliases".split()
)
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())
#: Built-in functions that do something else than compute.
CALLS = frozenset("reflect java_method try_reflect raise_error assert_true".split())


def check(query: str) -> None:
    """QueryEmpty for nothing, QueryInvalid for an open literal, QueryRejected for a word of WRITE_WORDS outside literals."""
    if not query.strip():
        raise error("QueryEmpty")
    bare = _LITERAL.sub(" ", query)
    if "'" in bare or '"' in bare:
        raise error("QueryInvalid", "unterminated string literal")
    m = _WORD.search(bare)
    if m:
        raise error("QueryRejected", f"{m[1].upper()} is not allowed", keyword=m[1].upper())


def _list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _parts(names) -> list[str]:
    return [str(p).lower() for p in _list(names)]


def _walk(plan, plans: list, expressions: list) -> None:
    """The plan and all plans in it, and all their expressions, subqueries and common table expressions included."""
    plans.append(plan)
    if plan.getClass().getSimpleName() == "UnresolvedWith":
        for cte in _list(plan.cteRelations()):
            _walk(cte.productElement(1), plans, expressions)
    for child in _list(plan.children()):
        _walk(child, plans, expressions)
    todo = _list(plan.expressions())
    while todo:
        e = todo.pop()
        expressions.append(e)
        todo += _list(e.children())
        if e.getClass().getSimpleName() in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
            _walk(e.plan(), plans, expressions)


def check_plan(spark: SparkSession, query: str, views: Iterable[str] | None = None) -> None:
    """QueryInvalid for what Spark cannot parse and for a view that is not there, QueryRejected for anything but reading from the given
    views (all temporary ones without it) by built-in functions."""
    session = spark._jsparkSession.sessionState()
    try:
        plan = session.sqlParser().parsePlan(query)
    except (PySparkException, Exception) as e:  # noqa: B014
        raise error("QueryInvalid", str(e).split("\n")[0][:300]) from None
    plans: list = []
    expressions: list = []
    kind = plan.getClass().getSimpleName().rstrip("$")
    if kind not in NODES:
        raise error("QueryRejected", f"only queries are allowed, not {kind}")
    _walk(plan, plans, expressions)
    known = {v.lower() for v in (views if views is not None else [t.name for t in spark.catalog.listTables() if t.isTemporary])}
    for p in plans:
        kind = p.getClass().getSimpleName().rstrip("$")
        if kind not in NODES:
            raise error("QueryRejected", f"{kind} is not allowed")
        if kind == "UnresolvedWith":
            known |= {str(cte.productElement(0)).lower() for cte in _list(p.cteRelations())}
    builtin = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    named = [_parts(e.nameParts()) for e in expressions if e.getClass().getSimpleName() == "UnresolvedFunction"]
    for e in expressions:
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedGenerator" and (e.name().database().isDefined() or e.name().funcName().lower() not in TABLE_FUNCTIONS):
            raise error("QueryRejected", f"table function {e.name().unquotedString()} is not allowed")
        if kind == "ExpressionWithUnresolvedIdentifier":
            raise error("QueryRejected", "computed names are not allowed")
    for name in named:
        if len(name) != 1 or name[0] in CALLS or not builtin.functionExists(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name[0])):
            raise error("QueryRejected", f"function {'.'.join(name)} is not allowed")
    for p in plans:
        kind = p.getClass().getSimpleName()
        if kind == "UnresolvedTableValuedFunction":
            name = _parts(p.name())
            if len(name) != 1 or name[0] not in TABLE_FUNCTIONS:
                raise error("QueryRejected", f"table function {'.'.join(name)} is not allowed")
        if kind == "UnresolvedRelation":
            name = _parts(p.multipartIdentifier())
            if len(name) != 1:
                raise error("QueryRejected", f"relation {'.'.join(name)} is not allowed")
            if name[0] not in known:
                raise error("QueryInvalid", f"no view {name[0]}")


def run(spark: SparkSession, query: str, row_limit: int = ROW_LIMIT, timeout_ms: int = TIMEOUT_MS, views: Iterable[str] | None = None) -> dict:
    """rows, row_count, truncated, elapsed_ms of a query over the session's views; QueryTimeout when the time is over."""
    check(query)
    query = query.strip().rstrip(";")
    check_plan(spark, query, views)
    tag = f"adhoc-{uuid.uuid4().hex}"
    over = threading.Event()

    def stop() -> None:
        over.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout_ms / 1000, stop)
    began = time.monotonic()
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        rows = spark.sql(query).limit(row_limit + 1).collect()  # bounded by the row limit
    except Exception as e:
        raise error("QueryTimeout") if over.is_set() else error("QueryInvalid", str(e).split("\n")[0][:300]) from None
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
    return {"rows": [r.asDict(recursive=True) for r in rows[:row_limit]], "row_count": min(len(rows), row_limit), "truncated": len(rows) > row_limit, "elapsed_ms": int((time.monotonic() - began) * 1000)}
