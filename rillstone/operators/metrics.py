"""Retrieval metrics, classification metrics, label caches and data audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.functions import text as T
from rillstone.sources.shared import materialise


def gold_ranks(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, gold_rank): the best rank of a gold row among the hits, null where none is; a row per query of gold."""
    found = hits.join(gold, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("gold_rank"))
    return gold.select("query_id").distinct().join(found, "query_id", "left")


def metric_block() -> list[Column]:
    """Questions, hit rate, mean reciprocal rank and top-1 rate of rows with gold_rank."""
    hit = F.col("gold_rank").isNotNull()
    return [
        F.count(F.lit(1)).alias("questions"),
        F.round(F.avg(hit.cast("double")), 6).alias("hit_rate"),
        F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("gold_rank"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg((F.coalesce("gold_rank", F.lit(0)) == 1).cast("double")), 6).alias("gold_top1"),
    ]


def grouped_metrics(rows: DataFrame, *groups: str) -> DataFrame:
    """metric_block overall and by each group column, in one pass."""
    sets = [[], *[[g] for g in groups]]
    level = F.when(F.grouping(groups[0]) == 0, F.col(groups[0]))
    for g in groups[1:]:
        level = level.when(F.grouping(g) == 0, F.col(g))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(g) for g in groups]).agg(level.otherwise("overall").alias("level"), *metric_block())


def precision(label: Column, strict: bool = False) -> Column:
    return F.avg((label == 2 if strict else label >= 1).cast("double"))


def keyword_coverage(text: Column, keywords: Column) -> tuple[Column, Column, Column]:
    """Keywords found in the text, missing ones, and the share found to 3 places, 0 without keywords."""
    found = F.filter(keywords, lambda k: F.contains(text, k))
    share = F.when(F.size(keywords) > 0, F.round(F.size(found) / F.size(keywords).cast("double"), 3)).otherwise(0.0)
    return found, F.array_except(keywords, found), share


def combined_score(recall: Column, hit: Column, prec: Column, pool: Column) -> Column:
    return F.lit(0.5) * recall + F.lit(0.2) * hit + F.lit(0.25) * prec - F.lit(0.05) * pool / F.lit(40.0)


def confusion(rows: DataFrame, actual: str, predicted: str, labels: list) -> DataFrame:
    """(actual, predicted, n) for every pair of labels, zero cells kept."""
    spark = rows.sparkSession
    cells = spark.createDataFrame([(a, p) for a in labels for p in labels], f"actual {rows.schema[actual].dataType.simpleString()}, predicted {rows.schema[predicted].dataType.simpleString()}")
    n = rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(n, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_metrics(rows: DataFrame, actual: str, predicted: str, labels: list) -> DataFrame:
    """Precision, recall, F1 and support of each label, zero where nothing divides."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    parts = []
    for label in labels:
        a, p = F.col(actual) == label, F.col(predicted) == label
        parts.append(F.struct(F.lit(label).alias("label"), F.count_if(a & p).cast("double").alias("tp"), F.count_if(p).cast("double").alias("said"), F.count_if(a).cast("double").alias("is")))
    each = rows.agg(F.array(*parts).alias("x")).select(F.inline("x"))
    prec, rec = ratio(F.col("tp"), F.col("said")), ratio(F.col("tp"), F.col("is"))
    return each.select("label", F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"), F.round(ratio(2 * prec * rec, prec + rec), 6).alias("f1"), F.col("is").cast("long").alias("support"))


def merge_caches(*caches: DataFrame) -> DataFrame:
    """Label caches (query_id, doc_id, label, reason) merged in order: the first label of a key stands.

    A later row that agrees replaces the reason; one that does not is counted as a conflict.
    """
    rows = None
    for n, cache in enumerate(caches):
        part = cache.select("query_id", "doc_id", "label", "reason", F.lit(n).alias("cache_no"))
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy("query_id", "doc_id").agg(F.min_by("label", "cache_no").alias("kept"))
    joined = rows.join(first, ["query_id", "doc_id"])
    same = F.col("label") == F.col("kept")
    return joined.groupBy("query_id", "doc_id").agg(F.max("kept").alias("label"), F.max_by(F.when(same, F.col("reason")), F.when(same, F.col("cache_no"))).alias("reason"), F.count_if(~same).alias("conflicts"))


def audit(questions: DataFrame, chunks: DataFrame, required: list[str]) -> DataFrame:
    """Problems of an evaluation table (id, question, doc_id, evidence): one row per problem, with the id it points to."""
    key = T.question_key(F.col("question"))
    first_id = Window.partitionBy("id").orderBy("row_no")
    first_question = Window.partitionBy(key).orderBy("row_no")
    lookup = chunks.select("doc_id", F.col("text").alias("now"))
    linked = questions.join(lookup, "doc_id", "left")
    problem = lambda frame, kind, other: frame.select("id", F.lit(kind).alias("problem"), other.cast("string").alias("detail"))
    missing = [problem(questions.where(F.coalesce(T.stripped(F.col(c).cast("string")), F.lit("")) == ""), "missing_field", F.lit(c)) for c in required]
    repeated = problem(questions.withColumn("n", F.row_number().over(first_id)).where("n > 1"), "duplicate_id", F.col("id"))
    alike = problem(questions.withColumn("n", F.row_number().over(first_question)).withColumn("first", F.first("id").over(first_question)).where("n > 1"), "duplicate_question", F.col("first"))
    gone = problem(linked.where(F.col("now").isNull()), "missing_chunk", F.col("doc_id"))
    stale = problem(linked.where(F.col("now").isNotNull() & (F.col("now") != F.col("evidence"))), "stale_evidence", F.col("doc_id"))
    out = repeated
    for part in [alike, gone, stale, *missing]:
        out = out.unionByName(part)
    return out


def verdict(support: Column, clarity: Column, quality: Column) -> Column:
    return F.when((support == 0) | (clarity == 0), "remove").when((support == 2) & (clarity == 2) & (quality >= 1), "keep").otherwise("review")


def grouped_percentiles(rows: DataFrame, group: str, value: str, shares: dict[str, float], margin: float = 0.002) -> DataFrame:
    """(group, mean, one column for each share): exact percentiles, interpolated as percentile() does.

    percentile() brings all distinct values of a group to one task. Here a first pass has bounds around each percentile, from a
    sketch that is twenty times finer than the margin; a second counts what lies below and the values between, which alone are sorted.
    """
    number = F.col(value).cast("double")
    ends = [x for p in shares.values() for x in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = rows.groupBy(group).agg(F.count(value).alias("_n"), F.avg(value).alias("mean"), F.percentile_approx(number, ends, 10_000).alias("_ends"))
    bounds = materialise(sketch, "percentile-bounds")
    known = bounds.select(F.col(group).alias("_g"), "_n", "_ends")
    near = rows.where(F.col(value).isNotNull()).select(F.col(group), number.alias("_v")).join(known, F.col(group).eqNullSafe(F.col("_g")))
    large = F.col("_n") > 10_000  # in a small group neighbouring places may lie beyond the margin
    tag = lambda k, name, p: F.struct(F.lit(name).alias("share"), F.lit(p).alias("p"), (large & (F.col("_v") < F.col("_ends")[2 * k])).alias("below"), (large & (F.col("_v") > F.col("_ends")[2 * k + 1])).alias("above"))
    tagged = near.select(group, "_n", "_v", F.explode(F.array(*[tag(k, name, p) for k, (name, p) in enumerate(shares.items())])).alias("t")).where(~F.col("t.above"))
    counted = tagged.groupBy(group, "_n", "t.share", "t.p", F.when(~F.col("t.below"), F.col("_v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(group, "share").orderBy(F.col("v").asc_nulls_first())
    placed = counted.withColumn("last", F.sum("c").over(order))  # places last - c up to last, from 0 on
    at = (F.col("_n") - 1) * F.col("p")
    holds = lambda place: F.max(F.when((F.col("last") - F.col("c") <= place) & (place < F.col("last")), F.col("v")))
    found = placed.groupBy(group, "share", at.alias("at")).agg(holds(F.floor(at)).alias("lower"), holds(F.ceil(at)).alias("upper"))
    outside = F.raise_error(F.lit("a percentile lies outside its bounds"))
    between = (F.ceil("at") - F.col("at")) * F.col("lower") + (F.col("at") - F.floor("at")) * F.col("upper")
    exact = F.when(F.col("lower").isNull() | F.col("upper").isNull(), outside.cast("double")).when(F.col("lower") == F.col("upper"), F.col("lower")).otherwise(between)
    each = found.groupBy(F.col(group).alias("_g")).agg(*[F.max(F.when(F.col("share") == name, exact)).alias(name) for name in shares])
    return bounds.join(each, F.col(group).eqNullSafe(F.col("_g")), "left").select(group, "mean", *shares)


def value_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """(column_name, value, n) of several columns, in one pass over the rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    return rows.select(pairs).groupBy("p.column_name", "p.value").agg(F.count(F.lit(1)).alias("n"))


def quota_sample(rows: DataFrame, quotas: dict[str, int], kind_col: str, group_col: str, id_col: str) -> DataFrame:
    """Per kind, as many rows as its quota, balanced over groups: rounds over the groups, smallest ids first.

    Taking the row of the least used group over and over is one round-robin: a row's turn is its number within
    its group, so the order is (turn, id) and needs no loop.
    """
    turn = F.row_number().over(Window.partitionBy(kind_col, group_col).orderBy(id_col))
    place = F.row_number().over(Window.partitionBy(kind_col).orderBy("turn", id_col))
    limit = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col(kind_col)]
    return rows.withColumn("turn", turn).withColumn("place", place).where(F.col("place") <= limit).drop("turn", "place")


def seeded_sample(rows: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """n rows by a hash of seed and id."""
    return rows.withColumn("_draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col)))).orderBy("_draw", id_col).limit(n).drop("_draw")
