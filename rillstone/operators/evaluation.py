"""Building, checking and scoring evaluation sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.functions import text as T
from rillstone.operators import metrics

# The routes of evaluation questions and the actions that follow from them.
ROUTES = ("clear", "expandable", "ambiguous")
EVALUATION_ID = r"^QH\d{2}-[12]$"


def rate(hits: Column, total: Column, places: int = 6) -> Column:
    """hits over total, rounded; zero where there is nothing."""
    return F.when(total > 0, F.round(hits / total.cast("double"), places)).otherwise(0.0)


def agreement(rows: DataFrame, first: str, second: str, by: str) -> tuple[DataFrame, DataFrame]:
    """Per group the precision of two judges, and over all rows how often they agree with the mean of the groups' precisions."""
    each = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("items"), F.sum((F.col(first) == F.col(second)).cast("long")).alias("agree"),
        *[F.round(metrics.precision(F.col(c), strict), 4).alias(f"{c}_{name}") for c in (first, second) for strict, name in ((False, "loose"), (True, "strict"))],
    )
    macro = [F.round(F.avg(f"{c}_{name}"), 4).alias(f"{c}_{name}") for c in (first, second) for name in ("loose", "strict")]
    return each, each.agg(F.sum("items").alias("items"), rate(F.sum("agree"), F.sum("items"), 4).alias("agreement"), *macro)


def section_hit(expected: Column, results: Column) -> Column:
    """Whether the expected section occurs in any of the results' texts."""
    return F.exists(results, lambda r: F.contains(r, expected))


def joined_coverage(results: DataFrame, query_col: str, text_col: str, rank_col: str, keywords: DataFrame) -> DataFrame:
    """(query, found, total, coverage): keywords found in a query's texts put together in rank order."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank_col, text_col))), lambda x: x[text_col]), "\n")
    rows = results.groupBy(query_col).agg(texts.alias("_text")).join(keywords, query_col)
    found, _, share = metrics.keyword_coverage(F.col("_text"), F.col("keywords"))
    return rows.select(query_col, F.size(found).cast("long").alias("found"), F.size("keywords").cast("long").alias("total"), share.alias("coverage"))


def micro_rates(rows: DataFrame, model: str, hits: dict[str, tuple[str, str]]) -> DataFrame:
    """Per model the questions and, by name, the sum of hits over the sum of totals, to 3 places."""
    return rows.groupBy(model).agg(F.count(F.lit(1)).alias("questions"), *[rate(F.sum(h), F.sum(t), 3).alias(name) for name, (h, t) in hits.items()])


def classification(rows: DataFrame, actual: str, predicted: str, labels: list) -> DataFrame:
    """Accuracy, macro averages of the rounded class metrics (the mean recall is the balanced accuracy) and the share of the largest class, in one row."""
    each = metrics.class_metrics(rows, actual, predicted, labels)
    macro = each.agg(*[F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], F.max("support").alias("_most"), F.sum("support").alias("_all"))
    right = rows.agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col(actual) == F.col(predicted)).alias("correct"))
    both = right.join(F.broadcast(macro))  # a row each
    return both.select("questions", "correct", rate(F.col("correct"), F.col("questions")).alias("accuracy"), F.col("macro_recall").alias("balanced_accuracy"), "macro_precision", "macro_recall", "macro_f1", rate(F.col("_most"), F.col("_all")).alias("majority_baseline"))


def distribution(rows: DataFrame, *scores: str) -> DataFrame:
    """(dimension, score, n): how often each score occurs in each of several columns, in one pass."""
    return metrics.value_counts(rows, *scores).select(F.col("column_name").alias("dimension"), F.col("value").alias("score"), "n")


def label_rates(rows: DataFrame, by: str, label: str) -> DataFrame:
    """Per group the shares of labels 0, of 1 or 2, and of 2."""
    n = F.count(F.lit(1))
    share = lambda cond, name: rate(F.count_if(cond), n).alias(name)
    return rows.groupBy(by).agg(n.alias("n"), share(F.col(label) == 0, "irrelevant"), share(F.col(label) >= 1, "relevant"), share(F.col(label) == 2, "direct"))


def pivoted(rows: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    """A grid: one row for each of row, one column for each of the given values."""
    return rows.groupBy(row).pivot(column, values).agg(F.first(value))


def work_list(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows with the same keys the first in the given order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", place).where("_n = 1").drop("_n")


def with_labels(rows: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with the labels of a cache, and per source ("cache" or "new") how many; missing labels are left to a judge."""
    found = rows.join(cache, keys, "left").withColumn("label_source", F.when(F.col("label").isNull(), "new").otherwise("cache"))
    return found, found.groupBy("label_source").agg(F.count(F.lit(1)).alias("n"))


def with_full_evidence(rows: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """rows with the chunk's text as evidence, their own preview where the chunk is gone, and which of the two it is."""
    found = rows.join(chunks.select(key, F.col("text").alias("_full")), key, "left")
    return found.withColumn("evidence", F.coalesce("_full", "preview")).withColumn("evidence_source", F.when(F.col("_full").isNull(), "preview").otherwise("chunk")).drop("_full")


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, missing_in): keys that one of two tables lacks."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("missing_in", F.lit("right")).unionByName(b.join(a, key, "left_anti").withColumn("missing_in", F.lit("left")))


def question_problems(rows: DataFrame) -> DataFrame:
    """(query_id, problem): what is wrong with evaluation questions.

    rows: query_id, user_query, canonical_query, must_preserve (array), expected_route,
    relevant_chunk_id, expected_clarifying_question, clarification_slots (array).
    """
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    unclear = F.col("expected_route") == "ambiguous"
    rules = {
        "invalid_route": ~F.coalesce("expected_route", F.lit("")).isin(*ROUTES),
        "empty_user_query": empty("user_query"),
        "empty_canonical_query": empty("canonical_query"),
        "empty_must_preserve": none("must_preserve"),
        "ambiguous_with_gold": unclear & F.col("relevant_chunk_id").isNotNull(),
        "missing_clarifying_question": unclear & empty("expected_clarifying_question"),
        "missing_slots": unclear & none("clarification_slots"),
        "missing_gold": ~unclear & F.col("relevant_chunk_id").isNull(),
    }
    found = F.filter(F.array(*[F.when(broken, name) for name, broken in rules.items()]), lambda x: x.isNotNull())
    each = rows.select("query_id", F.explode(found).alias("problem"))
    repeated = [rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(c))).where("_n > 1").select("query_id", F.lit(f"duplicate_{c}").alias("problem")) for c in ("query_id", "user_query")]
    return reduce(DataFrame.unionByName, repeated, each)


def decided(rows: DataFrame, decision: str, expected: str) -> DataFrame:
    """rows with state accepted, rejected or undecided by a reviewer's yes or no, and without an expected value where none is accepted."""
    said = F.lower(F.trim(F.coalesce(decision, F.lit(""))))
    state = F.when(said == "yes", "accepted").when(said == "no", "rejected").otherwise("undecided")
    return rows.withColumn("state", state).withColumn(expected, F.when(F.col("state") == "accepted", F.col(expected)))


def ready(rows: DataFrame, label: str, least: int = 8) -> DataFrame:
    """(accepted, smallest_class, ready): whether every class of the accepted rows has so many."""
    sizes = rows.where("state = 'accepted'").groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("accepted"), F.coalesce(F.min("n"), F.lit(0)).alias("smallest_class"), (F.coalesce(F.min("n"), F.lit(0)) >= least).alias("ready"))


def variants(rows: DataFrame, id_col: str, query_col: str, overrides: DataFrame | None = None) -> DataFrame:
    """A row for each route of a source question, with ids "<id>-<route>"; overrides (variant_id, query) replace texts."""
    out = rows.select("*", F.explode(F.array(*map(F.lit, ROUTES))).alias("expected_route")).withColumn("variant_id", F.concat_ws("-", F.col(id_col).cast("string"), "expected_route")).withColumn("query", F.col(query_col))
    if overrides is not None:
        out = out.join(overrides.withColumnRenamed("query", "_other"), "variant_id", "left").withColumn("query", F.coalesce("_other", "query")).drop("_other")
    return out.withColumn("expected_action", action_of("expected_route"))


def action_of(route: str) -> Column:
    return F.when(F.col(route) == "ambiguous", "clarify").otherwise("retrieve")


def is_evaluation_row(id_col: str, action: str) -> Column:
    """Whether a row is one of the retrievable evaluation questions."""
    return F.col(id_col).rlike(EVALUATION_ID) & (F.col(action) == "retrieve")


def numbered(rows: DataFrame, order: str, prefix: str = "Q", group: int = 1000) -> DataFrame:
    """rows with evaluation_id Q001, Q002 and so on in the given order.

    Places are counted within ranges of the order and added up over the ranges, so no task sees all rows.
    """
    cuts = rows.select(F.floor(F.col(order) / group).alias("_g"), "*")
    sizes = cuts.groupBy("_g").agg(F.count(F.lit(1)).alias("_s"))
    before = sizes.select("_g", (F.sum("_s").over(Window.orderBy("_g")) - F.col("_s")).alias("_b"))
    place = F.row_number().over(Window.partitionBy("_g").orderBy(order)) + F.col("_b")
    return cuts.join(before, "_g").withColumn("evaluation_id", F.format_string(f"{prefix}%03d", place)).drop("_g", "_b")


def result_rows(hits: DataFrame, keywords: DataFrame) -> DataFrame:
    """A row for each query with its hits as an array in rank order, the coverage of all their texts and the best one's id and text."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "text")))
    rows = hits.groupBy("query_id").agg(listed.alias("results")).join(keywords, "query_id")
    found, missing, share = metrics.keyword_coverage(F.array_join(F.transform("results", lambda r: r["text"]), "\n"), F.col("keywords"))
    return rows.select("query_id", "results", found.alias("found"), missing.alias("missing"), share.alias("coverage"), F.col("results")[0]["doc_id"].alias("top1_doc_id"), F.col("results")[0]["text"].alias("top1_text"))


def two_level_metrics(rows: DataFrame, outer: str, inner: str, timing: str) -> DataFrame:
    """metric_block with the mean of a timing for each of outer and for each pair of outer and inner, in one pass."""
    sets = [[F.col(outer)], [F.col(outer), F.col(inner)]]
    level = F.when(F.grouping(inner) == 1, "all").otherwise(F.col(inner))
    return rows.groupingSets(sets, F.col(outer), F.col(inner)).agg(level.alias("variant"), *metrics.metric_block(), F.round(F.avg(timing), 6).alias("mean_seconds")).drop(inner)


def from_specs(specs: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """Candidates of a table of specifications joined to their source questions; a specification without one is an error."""
    joined = specs.join(questions, key, "left")
    return joined.where(F.when(F.col("question").isNull(), F.raise_error(F.concat(F.lit("no source question: "), F.col(key).cast("string")))).otherwise(True))


def manual_annotations(text_rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(question_id, question, rank, label, reason, preview) of annotation files: "## Q1: ..." blocks of "### Rank 1" blocks with "- label: ..." lines."""
    blocks = text_rows.select(F.explode(F.split(text_col, r"(?m)(?=^## Q\d+)")).alias("block")).where(F.col("block").rlike(r"^## Q\d+"))
    head = lambda k: F.regexp_extract("block", r"^## (Q\d+)[:：.]?[ \t]*(.*)", k)
    ranks = blocks.select(head(1).alias("question_id"), T.stripped(head(2)).alias("question"), F.explode(F.split("block", r"(?m)(?=^### )")).alias("part")).where(F.col("part").rlike(r"^### .*?\d+"))
    field = lambda name: T.without_ticks(F.regexp_extract("part", rf"(?m)^- {name}[:：][ \t]*(.*)$", 1))
    return ranks.select("question_id", "question", F.regexp_extract("part", r"^### .*?(\d+)", 1).cast("int").alias("rank"), field("label").try_cast("int").alias("label"), field("reason").alias("reason"), field("preview").alias("preview"))
