"""A guard for read-only SQL: what a statement may do is decided on the plan that Spark's parser makes of it.

A plan passes if every node in it is one of those that only read, every relation is an
allowed table or a common table expression of the statement, and no function reaches out of
the data. Beyond that, statements with comments, with several parts or with a forbidden word
are turned away as text, as callers rely on it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession

# The words that no statement may hold outside of quotes.
FORBIDDEN = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE", "CREATE", "REPLACE", "GRANT", "REVOKE")
#: Plan nodes that only read.
READING = frozenset(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Tail Distinct Deduplicate Union Except Intersect SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation OneRowRelation"
    " UnresolvedHaving UnresolvedInlineTable UnresolvedWith WithWindowDefinition Window Pivot UnresolvedPivot Unpivot LateralJoin Generate Sample UnresolvedOrderedRelation".split()
)
#: Functions that call into the machine instead of computing on rows.
UNSAFE = frozenset(("reflect", "java_method", "try_reflect", "input_file_name", "raise_error", "version", "current_user", "session_user", "user", "read_files", "read_kafka"))


class RejectedSql(ValueError):
    """The statement breaks a rule of the guard."""


def cleaned(sql: str) -> str:
    """The statement in an answer: from the first SELECT to the end or the closing fence; all of it where there is none."""
    found = re.search(r"\bselect\b.*?(?=\s*(?:```\s*)?\Z)", sql or "", re.I | re.S)
    return found[0] if found else (sql or "").strip("` \n\t")


def unquoted(sql: str) -> str:
    """The parts of a statement outside of quotes, each quoted part a blank."""
    return " ".join(re.split(r"""'[^']*'|"[^"]*\"""", sql))


def _each(found) -> Iterator:  # noqa: ANN001
    return (found.apply(k) for k in range(found.size()))


def nodes(plan) -> Iterator:  # noqa: ANN001
    """All nodes of a parsed plan and of the plans in its expressions and common table expressions."""
    yield plan
    kind = plan.getClass().getSimpleName()
    inner = [pair._2() for pair in _each(plan.cteRelations())] if kind == "UnresolvedWith" else []
    for child in chain(_each(plan.children()), inner):
        yield from nodes(child)
    for expression in _each(plan.expressions()):
        yield from _expression_nodes(expression)


def _expression_nodes(expression) -> Iterator:  # noqa: ANN001
    yield expression
    if "SubqueryExpression" in {c.getSimpleName() for c in _classes(expression)}:
        yield from nodes(expression.plan())
    for child in _each(expression.children()):
        yield from _expression_nodes(child)


def _classes(thing) -> Iterator:  # noqa: ANN001
    now = thing.getClass()
    while now is not None:
        yield now
        now = now.getSuperclass()


def objections(spark: SparkSession, sql: str, allowed: set[str]) -> Iterator[str]:
    """What speaks against a statement that parses."""
    own: set[str] = set()
    for node in nodes(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)):
        kind = node.getClass().getSimpleName()
        plan = any(c.getSimpleName() == "LogicalPlan" for c in _classes(node))
        if kind == "UnresolvedWith":
            own |= {pair._1().lower() for pair in _each(node.cteRelations())}
        if plan and kind not in READING:
            yield f"{kind} is not allowed"
        elif kind == "UnresolvedRelation":
            name = ".".join(_each(node.multipartIdentifier())).lower()
            if name not in own and name not in allowed:
                yield f"unknown table: {name}"
        elif kind == "UnresolvedFunction":
            name = ".".join(_each(node.nameParts())).lower()
            if name.rsplit(".", 1)[-1] in UNSAFE:
                yield f"{name}() is not allowed"


def checked(spark: SparkSession, sql: str, allowed: set[str]) -> str:
    """The statement, if it is one SELECT without comments or forbidden words over allowed tables."""
    text = cleaned(sql).rstrip("; \n\t")
    bare = unquoted(text)
    words = set(re.findall(r"\w+", bare.upper()))
    refusals = {
        "only SELECT is allowed": not re.match(r"select\b", bare, re.I),
        "comments are not allowed": bool(re.search(r"--|/\*|\*/", bare)),
        "only one statement is allowed": ";" in bare,
        **{f"{word} is not allowed": word in words for word in FORBIDDEN},
    }
    if reason := next((why for why, holds in refusals.items() if holds), None):
        raise RejectedSql(reason)
    try:
        found = next(objections(spark, text, {a.lower() for a in allowed}), None)
    except Exception as e:
        raise RejectedSql(f"the statement does not parse: {str(e)[:200]}") from e
    if found:
        raise RejectedSql(found)
    return text


def run(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The rows of a checked statement over the given tables."""
    text = checked(spark, sql, set(tables))
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)
    return spark.sql(text)


def envelope(spark: SparkSession, question: str, sql: str, tables: dict[str, DataFrame]) -> dict:
    """Question, statement, row count, and all rows as a frame of JSON strings, which stays distributed."""
    rows = run(spark, sql, tables)
    return {"question": question, "sql": cleaned(sql).rstrip("; \n\t"), "row_count": rows.count(), "rows": rows.selectExpr("to_json(struct(*)) AS row")}
