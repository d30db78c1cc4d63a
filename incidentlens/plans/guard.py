"""The guarded SQL channel: one read-only SELECT over published views, checked before it runs.

Layers: the session's own parser (one statement); an allow-list of node classes over the whole unresolved
tree, common table expressions and subqueries included; only registered relation names; a deny-list of
functions that leave the engine and no table functions but ``explode``-like generators; a row cap; a time limit.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

MAX_ROWS, TOOL_ROWS = 500, 200
#: How long a query of the tools and the server may run.
SECONDS = 10.0
#: Logical operators that only read.
ALLOWED = frozenset(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except SubqueryAlias UnresolvedRelation UnresolvedWith "
    "UnresolvedHaving UnresolvedSubqueryColumnAliases WithWindowDefinition OneRowRelation UnresolvedInlineTable LateralJoin Generate Window SetOperation Tail "
    "ResolvedInlineTable LocalRelation UnresolvedOrdinal Sample Pivot Unpivot Expand".split()
)
#: Functions that reach outside the data: the JVM, files, the network or the session.
DENIED = frozenset(
    "reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length current_user session_user user current_database "
    "current_schema current_catalog read_files http_request version spark_partition_id monotonically_increasing_id assert_true raise_error".split()
)


class ReadOnlyViolation(ValueError):
    """A statement that isn't a plain read of the published views."""


def _nodes(plan) -> Iterable:
    """Every logical node: children, subqueries in expressions, and the bodies of common table expressions."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        for group in ("children", "innerChildren", "subqueries"):
            seq = getattr(node, group)()
            for i in range(seq.size()):
                child = seq.apply(i)
                if hasattr(child, "getClass") and "LogicalPlan" in _bases(child):
                    todo.append(child)


def _bases(obj) -> str:
    names, cls = [], obj.getClass()
    while cls is not None:
        names.append(cls.getSimpleName())
        cls = cls.getSuperclass()
    return " ".join(names)


def relations(spark: SparkSession, sql: str) -> set[str]:
    """Names of the tables that a statement reads, common table expressions among them."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    named = [n.multipartIdentifier() for n in _nodes(plan) if n.getClass().getSimpleName() == "UnresolvedRelation"]
    return {".".join(parts.apply(i) for i in range(parts.size())).lower() for parts in named}


def _inspect(spark: SparkSession, sql: str, views: frozenset[str]) -> None:
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise ReadOnlyViolation(f"not one valid statement: {str(e).splitlines()[0][:200]}") from None
    own: set[str] = set()
    seen: list[str] = []
    for node in _nodes(plan):
        name = node.getClass().getSimpleName()
        if name not in ALLOWED:
            raise ReadOnlyViolation(f"{name} isn't a read")
        if name == "UnresolvedWith":
            relations = node.cteRelations()
            own.update(str(relations.apply(i)._1()).lower() for i in range(relations.size()))
        if name == "UnresolvedRelation":
            seen.append(".".join(node.multipartIdentifier().apply(i) for i in range(node.multipartIdentifier().size())).lower())
    if unknown := [r for r in seen if r not in views and r not in own]:
        raise ReadOnlyViolation(f"no such table: {', '.join(sorted(set(unknown)))}")
    text = re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", sql)
    if called := {f.lower() for f in re.findall(r"`?([A-Za-z_]\w*)`?\s*\(", text)} & DENIED:
        raise ReadOnlyViolation(f"function not allowed: {', '.join(sorted(called))}")


def run_readonly(spark: SparkSession, sql: str, views: dict[str, DataFrame], max_rows: int = MAX_ROWS, time_limit: float | None = None) -> DataFrame:
    """The rows of one SELECT over ``views``, ``max_rows`` at most; ReadOnlyViolation for anything else.

    With ``time_limit`` (seconds) the query runs here, and its jobs are cancelled when the time is over, which is a violation too.

    Views are published in a session of their own, so a query can see nothing else.
    """
    session = spark.newSession()
    for key, value in (("spark.sql.runSQLOnFiles", "false"), ("spark.sql.session.timeZone", "UTC")):
        session.conf.set(key, value)
    _inspect(session, sql, frozenset(name.lower() for name in views))
    for name, df in views.items():
        plan = df._jdf.queryExecution().analyzed()
        DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan), session).createOrReplaceTempView(name)
    try:
        found = session.sql(sql)
    except Exception as e:
        raise ReadOnlyViolation(str(e).splitlines()[0][:300]) from None
    found = found.limit(max_rows)
    if time_limit is None:
        return found
    # Jobs of this thread carry the tag, so cancelling ends no others.
    tag, context, late = f"guard-{uuid.uuid4().hex}", spark.sparkContext, threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    context.addJobTag(tag)
    timer = threading.Timer(time_limit, stop)
    timer.start()
    try:
        rows = found.collect()  # max_rows at most
    except Exception as e:
        if late.is_set():
            raise ReadOnlyViolation(f"the query was stopped after {time_limit:g} seconds; ask for less") from None
        raise ReadOnlyViolation(str(e).splitlines()[0][:300]) from None
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    return spark.createDataFrame(rows, found.schema)
