"""Constraint checks on decisions, their fallbacks and tools, citations and replies."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.functions import text as T


class Policy(NamedTuple):
    """What a route allows: actions, whether keywords may and a brief must or may come along, and its tools."""

    actions: tuple[str, ...] = ("answer",)
    keywords: bool = False
    brief: str = "none"
    tools: tuple[str, ...] = ()


# Routes with their actions and tools, the skill of reports, the actions after a check of evidence, and replies.
POLICIES = {
    "rag": Policy(tools=("search_knowledge_base",)),
    "web": Policy(tools=("web_search",)),
    "rag_and_web": Policy(tools=("search_knowledge_base", "web_search")),
    "direct": Policy(tools=("calculator", "get_current_time")),
    "clarify": Policy(keywords=True),
    "sql": Policy(tools=("query_marketing_database",)),
    "douyin": Policy(("answer", "collect"), True, "may", ("query_douyin_index_data",)),
    "report": Policy(("generate_report",), True, "must"),
}
REPORT_SKILL = "douyin-research-report"
SUFFICIENCY_ACTIONS = ("answer", "web", "answer_insufficient")
UNVERIFIED = "无法可靠验证检索证据是否足够"
FALLBACK_ROUTE = "Router 失败，回退到原 Agent："
FALLBACK_CHECK = "Sufficiency Judge 失败，采用保守回退："

ROUTE_FIELDS = "route string, action string, needs_clarification boolean, clarification_question string, retrieval_query string, selected_skill string, keywords array<string>, brief_path string, reason string"
CHECK_FIELDS = "sufficient boolean, next_action string, answerable_aspects array<string>, missing_information array<string>, reason string"


def first_failure(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule whose condition for failing holds; null where none does."""
    return F.coalesce(*[F.when(F.coalesce(failed, F.lit(False)), name) for name, failed in rules])


def blank(text: str) -> Column:
    return F.coalesce(T.stripped(F.col(text)), F.lit("")) == ""


def _folded(name: str, absent: str) -> Column:
    return F.lower(T.stripped(F.coalesce(name, F.lit(absent))))


def filled(values: str) -> Column:
    """A list's strings without blanks around them, without blank ones and repeats, in their order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), T.stripped), lambda x: x != ""))


def _where(allows) -> Column:  # noqa: ANN001
    """Whether the route is one whose policy the test holds for."""
    return _folded("route", "").isin(*[r for r, p in POLICIES.items() if allows(p)])


def _only(wanted: Column, field: str) -> dict[str, Column]:
    """A text field that some routes need and all others must not have."""
    return {f"{field}_missing": wanted & blank(field), f"{field}_unwanted": ~wanted & F.col(field).isNotNull()}


def route_violation(skills: tuple[str, ...] = ()) -> Column:
    """The first rule that a routing decision (ROUTE_FIELDS) breaks, field by field; null for a valid one. skills: known ones besides the reports'."""
    route, action, skill = _folded("route", ""), _folded("action", "answer"), F.col("selected_skill")
    clarify, index, held = route == "clarify", _where(lambda p: "collect" in p.actions), F.size(filled("keywords")) > 0
    actions = F.create_map(*[x for r, p in POLICIES.items() for x in (F.lit(r), F.array(*map(F.lit, p.actions)))])
    fields = {
        "route": {"route_unknown": ~route.isin(*POLICIES)},
        "flag": {"flag_missing": F.col("needs_clarification").isNull(), "flag_mismatch": F.col("needs_clarification") != clarify},
        "reason": {"reason_missing": blank("reason")},
        "question": _only(clarify, "clarification_question"),
        "query": _only(~clarify, "retrieval_query"),
        "skill": {"skill_unknown": ~skill.isin(REPORT_SKILL, *skills), "skill_mismatch": (route == "report") != (F.coalesce(skill, F.lit("")) == REPORT_SKILL)},
        "action": {"action_unfit": ~F.array_contains(actions[route], action)},
        "keywords": {"keywords_unwanted": ~_where(lambda p: p.keywords) & held},
        "brief": {
            "brief_missing": (_where(lambda p: p.brief == "must") | index & (action == "collect")) & blank("brief_path"),
            "brief_unwanted": _where(lambda p: p.brief == "none") & F.col("brief_path").isNotNull(),
            "index_without_input": index & ~held & blank("brief_path"),
        },
    }
    return first_failure(*[rule for group in fields.values() for rule in group.items()])


def sufficiency_violation() -> Column:
    """The first rule that a check of evidence (CHECK_FIELDS) breaks; null for a valid one."""
    action = _folded("next_action", "")
    return first_failure(
        ("flag_missing", F.col("sufficient").isNull()),
        ("action_unknown", ~action.isin(*SUFFICIENCY_ACTIONS)),
        ("action_mismatch", F.col("sufficient") != (action == "answer")),
        ("reason_missing", blank("reason")),
    )


def normalised_check() -> Column:
    """A check of evidence with trimmed lists; the conservative fallback in place of one that breaks a rule or has no evidence."""
    broken = sufficiency_violation()
    given = F.struct("sufficient", _folded("next_action", "").alias("next_action"), filled("answerable_aspects").alias("answerable_aspects"), filled("missing_information").alias("missing_information"), T.stripped(F.col("reason")).alias("reason"), F.lit(False).alias("used_fallback"))
    none = F.array().cast("array<string>")
    safe = F.struct(F.lit(False).alias("sufficient"), F.lit("answer_insufficient").alias("next_action"), none.alias("answerable_aspects"), F.array(F.lit(UNVERIFIED)).alias("missing_information"), F.concat(F.lit(FALLBACK_CHECK), broken).alias("reason"), F.lit(True).alias("used_fallback"))
    return F.when(broken.isNull(), given).otherwise(safe)


def fallback_route(query: Column, error: Column) -> Column:
    """The decision in place of one that could not be made: answer the query directly as it is."""
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit("direct").alias("route"), F.lit("answer").alias("action"), F.lit(False).alias("needs_clarification"), none.alias("clarification_question"), query.alias("original_query"), query.alias("retrieval_query"),
        none.alias("selected_skill"), F.array().cast("array<string>").alias("keywords"), none.alias("brief_path"), F.concat(F.lit(FALLBACK_ROUTE), error).alias("reason"), F.lit(True).alias("used_fallback"),
    )


def tools_left(route: Column, done: Column) -> Column:
    """The tools of a route that have not succeeded yet; none of an unknown route."""
    tools = F.create_map(*[x for r, p in POLICIES.items() for x in (F.lit(r), F.array(*map(F.lit, p.tools)).cast("array<string>"))])
    return F.array_except(F.coalesce(tools[route], F.array().cast("array<string>")), F.coalesce(done, F.array().cast("array<string>")))


def tool_query(original: Column, routed: Column) -> Column:
    """What a tool searches for: the routed query where there is one, whatever the tool was called with."""
    return F.coalesce(F.nullif(T.stripped(routed), F.lit("")), original)


def insufficient_reply(known: Column, missing: Column, head: str, has: str, lacks: str) -> Column:
    """A reply that says what the evidence covers and what it lacks, each list joined; parts without entries are left out."""
    part = lambda label, values: F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(values, "；")))
    return F.concat_ws("\n", F.lit(head), part(has, known), part(lacks, missing))


def search_envelope(evidence: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, original_query, retrieval_query, evidence): a row for each query with its evidence rows in rank order."""
    rest = [c for c in evidence.columns if c != "query_id"]
    listed = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in rest if c != "rank"]))).alias("evidence"))
    return queries.join(listed, "query_id", "left").withColumn("retrieval_query", tool_query(F.col("original_query"), F.col("retrieval_query")))


def distinct_queries(original: Column, generated: Column) -> Column:
    """Whether there are exactly two generated queries, neither blank, all different from each other and the original."""
    keys = F.transform(F.concat(F.array(original), generated), T.question_key)
    return (F.size(generated) == 2) & F.forall(keys, lambda k: k != "") & (F.size(F.array_distinct(keys)) == 3)


def citations(evidence: DataFrame) -> DataFrame:
    """(query_id, citation_no, source, section, chunk_index): the distinct sources of each query's evidence, by first rank."""
    known = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("Unknown")).alias(c)
    rows = evidence.select("query_id", "rank", known("source"), known("section"), known("chunk_index"))
    firsts = rows.groupBy("query_id", "source", "section", "chunk_index").agg(F.min("rank").alias("rank"))
    return firsts.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "source", "section", "chunk_index")).alias("citation_no"), "source", "section", "chunk_index")
