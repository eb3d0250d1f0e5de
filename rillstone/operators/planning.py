"""Keyword plans, batches, snapshots and the readiness of collected data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstone.functions import text as T

#: Names of periods and the days between their ends that they allow.
PERIODS = (("7d", 5, 9), ("14d", 12, 16), ("30d", 27, 33), ("6m", 170, 190))


def keyword_plan(briefs: DataFrame, rules: list[tuple[str, str, bool]], task_col: str, exclude_col: str | None = None) -> DataFrame:
    """(task, keyword, keyword_type, source_field, required, position): values of the rule fields in order.

    rules: field, type, required. The first occurrence of a keyword wins, without regard to case; keywords
    that the brief excludes are left out. Fields hold lists or separated strings.
    """
    values = lambda f: T.keywords(F.col(f)) if briefs.schema[f].dataType.simpleString() == "string" else F.col(f)
    parts = [_rule(values(f), n, f, kind, required) for n, (f, kind, required) in enumerate(rules)]
    excluded = F.transform(values(exclude_col), lambda v: F.lower(T.stripped(v))) if exclude_col else F.array().cast("array<string>")
    rows = briefs.select(F.col(task_col).alias("task"), excluded.alias("excluded"), F.explode(F.concat(*parts)).alias("k")).select("task", "excluded", "k.*")
    rows = rows.where((F.col("keyword") != "") & ~F.array_contains("excluded", F.lower("keyword")))
    first = Window.partitionBy("task", F.lower("keyword")).orderBy("rule", "at")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1")
    place = F.row_number().over(Window.partitionBy("task").orderBy("rule", "at"))
    return rows.select("task", "keyword", "keyword_type", "source_field", "required", place.alias("position"))


def _rule(values: Column, n: int, field: str, kind: str, required: bool) -> Column:
    return F.transform(values, lambda v, i: F.struct(F.lit(n).alias("rule"), i.alias("at"), T.stripped(v).alias("keyword"), F.lit(kind).alias("keyword_type"), F.lit(field).alias("source_field"), F.lit(required).alias("required")))


def batches(rows: DataFrame, count: int, group_col: str, order_col: str) -> DataFrame:
    """rows with batch_no from 1: batch i of c holds places n(i-1)//c up to n*i//c."""
    group = Window.partitionBy(group_col)
    place, n = F.row_number().over(group.orderBy(order_col)), F.count(F.lit(1)).over(group)
    return rows.withColumn("_p", place).withColumn("_n", n).withColumn("batch_no", F.floor((F.col("_p") * count - 1) / F.col("_n")).cast("int") + 1).drop("_p", "_n")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def period_band(spark: SparkSession, rows: DataFrame, start: str, end: str) -> DataFrame:
    """rows joined with the named band that the days between two dates fall in; the bands are four rows."""
    bands = spark.createDataFrame(PERIODS, "band string, low int, high int")
    days = F.datediff(F.col(end), F.col(start))
    return rows.join(F.broadcast(bands), days.between(F.col("low"), F.col("high"))).drop("low", "high")


def readiness(keywords: DataFrame, status: DataFrame, period: str) -> DataFrame:
    """(keyword, state, reason): usable, terminal or collect.

    status: keyword, status, requested_period, succeeded_tabs, skip_reason. Usable is a success, or a partial
    one with a tab, of the asked period; terminal is a skip because there is no index.
    """
    joined = keywords.select("keyword").distinct().join(status, "keyword", "left")
    done = (F.col("status") == "success") | ((F.col("status") == "partial") & (F.coalesce("succeeded_tabs", F.lit(0)) >= 1))
    match = F.coalesce(F.col("requested_period") == period, F.lit(False))
    terminal = (F.col("status") == "skipped") & (F.col("skip_reason") == "not_indexed")
    state = F.when(done & match, "usable").when(terminal, "terminal").otherwise("collect")
    reason = F.when(F.col("status").isNull(), "missing").when(done & ~match, "wrong_period").when((F.col("status") == "partial") & ~done, "no_tabs").when(state == "collect", F.col("status")).otherwise("")
    return joined.select("keyword", state.alias("state"), reason.alias("reason"))


def rollup(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One status for many: success, completed_with_skips where all else is terminal, else partial."""
    n = F.count(F.lit(1))
    good, skipped = F.count_if(F.col("state") == "usable"), F.count_if(F.col("state") == "terminal")
    return states.groupBy(*(by or [])).agg(F.when(good == n, "success").when(good + skipped == n, "completed_with_skips").otherwise("partial").alias("status"), good.alias("usable"), n.alias("keywords"))


def report_queries(questions: Column, subject: Column, templates: tuple[str, ...], most: int = 5) -> Column:
    """User questions, then templates filled with the subject; blanks and repeats dropped, the first few."""
    filled = F.array(*[F.format_string(t, subject) for t in templates])
    every = F.transform(F.concat(F.coalesce(questions, F.array().cast("array<string>")), filled), T.stripped)
    return F.slice(F.array_distinct(F.filter(every, lambda q: q != "")), 1, most)


def upsert(fresh: DataFrame, stored: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """fresh rows in which non-blank stored fields take precedence; keys match without regard to case."""
    old = stored.select(*[F.lower(F.col(k).cast("string")).alias(f"_{k}") for k in keys], *[F.col(f).alias(f"_old_{f}") for f in fields])
    on = [F.lower(F.col(k).cast("string")) == F.col(f"_{k}") for k in keys]
    joined = fresh.join(old, on, "left")
    keep = lambda f: F.when(F.trim(F.coalesce(F.col(f"_old_{f}").cast("string"), F.lit(""))) != "", F.col(f"_old_{f}")).otherwise(F.col(f)).alias(f)
    return joined.select(*[keep(c) if c in fields else F.col(c) for c in fresh.columns])


# The fields that keyword candidates come from, with label, kind, whether required, approved, priority and reason.
CANDIDATE_FIELDS = (
    ("brand_name", "品牌名称", "品牌", True, "yes", 1, "核心品牌词"),
    ("brand_aliases", "品牌别名", "品牌别名", True, "yes", 1, "品牌检索别名"),
    ("product_name", "商品名称", "商品", True, "yes", 1, "核心商品词"),
    ("product_category", "商品类别", "商品类别", True, "yes", 1, "核心品类词"),
    ("required_keywords", "必查关键词", "必查关键词", True, "yes", 1, "用户指定必查"),
    ("parent_category", "上级品类", "上级品类", False, "", 2, "扩大品类覆盖"),
    ("competitor_brands", "竞品品牌", "竞品品牌", False, "", 2, "竞品对比候选"),
    ("competitor_products", "竞品商品", "竞品商品", False, "", 2, "竞品商品候选"),
    ("selling_points", "核心卖点", "核心卖点", False, "", 3, "卖点趋势候选"),
    ("ingredient_keywords", "成分关键词", "成分", False, "", 3, "成分趋势候选"),
)
GENERATED, NO_RESULT, FAILED = "程序生成", "没有采集结果", "采集未成功"


def keyword_candidates(briefs: DataFrame, task_col: str = "task_name", exclude_col: str = "excluded_keywords", fields: tuple[tuple, ...] = CANDIDATE_FIELDS) -> DataFrame:
    """keyword_plan over the candidate fields that the briefs have, with label, approval, priority and reason of the field."""
    have = [f for f in fields if f[0] in briefs.columns]
    plan = keyword_plan(briefs, [(f, kind, required) for f, _, kind, required, *_ in have], task_col, exclude_col if exclude_col in briefs.columns else None)
    about = F.create_map(*[x for f, label, _, _, approved, priority, reason in have for x in (F.lit(f), F.struct(F.lit(label).alias("source_field"), F.lit(approved).alias("approved"), F.lit(priority).alias("priority"), F.lit(reason).alias("reason")))])
    own = about[F.col("source_field")]
    return plan.select(F.col("task").alias(task_col), "keyword", "keyword_type", own["source_field"].alias("source_field"), F.when(F.col("required"), "yes").otherwise("no").alias("required"), own["approved"].alias("approved"), own["reason"].alias("reason"), own["priority"].alias("priority"), F.lit(GENERATED).alias("notes"), "position")


def approved_keywords(items: Column) -> Column:
    """Keywords of items (keyword, approved) that are approved with a yes, without blanks and repeats, in their order."""
    yes = F.filter(items, lambda x: F.lower(T.stripped(F.coalesce(x["approved"], F.lit("")))) == "yes")
    return F.array_distinct(F.filter(F.transform(yes, lambda x: T.stripped(F.coalesce(x["keyword"], F.lit("")))), lambda k: k != ""))


def collected_evidence(keywords: DataFrame, latest_status: DataFrame) -> DataFrame:
    """(keyword, status, reason, tabs, failed_tabs): the newest collection of every keyword, tabs split by success.

    latest_status: keyword, status, reason, tabs (map of name to a map with a status). Keywords
    without a result, and those whose collection did not succeed, have a reason and no tabs.
    """
    rows = keywords.select(T.stripped(F.col("keyword")).alias("keyword")).where("keyword <> ''").distinct().join(latest_status, "keyword", "left")
    good = F.coalesce(F.col("status").isin("success", "partial"), F.lit(False))
    why = F.when(F.col("status").isNull(), NO_RESULT).when(~good, F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit(FAILED)))
    ok = lambda t: F.coalesce(t["status"], F.lit("")) == "success"
    tabs = F.map_filter("tabs", lambda name, t: ok(t))
    lost = F.transform_values(F.map_filter("tabs", lambda name, t: ~ok(t)), lambda name, t: F.coalesce(t["error"], t["reason"], F.lit(FAILED)))
    return rows.select("keyword", F.coalesce("status", F.lit("missing")).alias("status"), why.alias("reason"), F.when(good, tabs).alias("tabs"), F.when(good, lost).alias("failed_tabs"))


def keyword_rollup(tabs: DataFrame, expected: int) -> DataFrame:
    """(keyword, status, succeeded): success where as many tabs as expected succeeded, else partial."""
    n = F.count_if(F.col("status") == "success")
    return tabs.groupBy("keyword").agg(F.when(n == expected, "success").otherwise("partial").alias("status"), n.alias("succeeded"))


def unreviewed(tasks: DataFrame, reviewed: DataFrame, key: str) -> DataFrame:
    """Tasks that have no review yet; none of them may be prepared while there are any."""
    return tasks.select(key).distinct().join(reviewed.select(key), key, "left_anti")


def single_task(tasks: DataFrame) -> DataFrame:
    """The one task of a brief; any other number of them is an error when it is read."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    return tasks.limit(2).withColumn("_n", n).where(F.when(F.col("_n") != 1, F.raise_error(F.lit("a brief must hold exactly one task"))).otherwise(True)).drop("_n")


def effective_period(given: Column, brief: Column, has_brief: Column) -> Column:
    """The period of a collection: the one given, else 30d without a brief, else the brief's; an unknown one is an error."""
    period = F.coalesce(given, F.when(~has_brief, "30d").otherwise(brief))
    return F.when(period.isin(*[p for p, _, _ in PERIODS]), period).otherwise(F.raise_error(F.concat(F.lit("unknown period: "), F.coalesce(period, F.lit("none")))))


def tab_period(tab: Column, asked: Column) -> Column:
    """The period that a tab is collected for: correlations are of 7 days whatever was asked."""
    return F.when(tab == "correlation", "7d").otherwise(asked)


def stable(snapshots: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """snapshots with whether a text equals the one before it."""
    digest = F.sha1(F.col(text))
    return snapshots.withColumn("stable", F.coalesce(digest == F.lag(digest).over(Window.partitionBy(key).orderBy(order)), F.lit(False)))


def scroll_offsets(last: Column, step: int) -> Column:
    """Places of captures down a page: every step, and the very end."""
    return F.array_union(F.sequence(F.lit(0), last, F.lit(step)), F.array(last))
