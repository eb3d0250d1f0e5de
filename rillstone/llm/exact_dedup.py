"""Exact deduplication by a 128-bit content hash whose groups are confirmed byte by byte.

The texts are grouped by (hash, text): the hash decides where a row goes and which rows are
compared at all, the grouping itself compares the bytes, so two texts that merely share a
hash stay apart. Copies collapse before the shuffle (partial aggregation), so a text that
a third of all rows repeat costs one row per map task; its narrow member rows are joined
where they lie, without a shuffle.

Defined results: a null text counts as the empty text; an empty table gives no rows; rows
that repeat both id and text are kept or dropped together by ``annotate`` and collapse to
one row in ``distinct_documents``; a null id is never kept while a row with an id exists;
other columns, whatever their names, pass through ``distinct_documents`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.llm.common import HOT_KEYS, join_with_hot_keys, materialise, whole_text


def content_hash(text: Column) -> tuple[Column, Column]:
    """Two 64-bit halves of a 128-bit hash of the UTF-8 bytes."""
    return F.xxhash64(text), F.xxhash64(F.lit("second half"), text)


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: the id that stays for its text, the group's size, and whether this row stays.

    keep: "min" keeps the smallest id of equal texts (the stable choice), "max" the largest.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), whole_text(f"`{text_col}`").alias("_text"))
    h1, h2 = content_hash(F.col("_text"))
    groups = (
        rows.groupBy(h1.alias("_h1"), h2.alias("_h2"), "_text")
        .agg(pick("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(F.struct("_h1", "_h2", F.sha2("_text", 256).alias("_sha")).alias("_key"), "keep_id", "group_size")
    )
    groups = materialise(groups, "text-groups")
    members = rows.select("_id", F.struct(h1.alias("_h1"), h2.alias("_h2"), F.sha2("_text", 256).alias("_sha")).alias("_key"))
    members = materialise(members, "text-members")
    n = groups.agg(F.sum("group_size")).first()[0] or 0
    joined = join_with_hot_keys(members, groups, "_key", hot=groups.where(F.col("group_size") * HOT_KEYS > n).select("_key")).withColumn("_sha", F.col("_key._sha"))
    return joined.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows that stay, with all columns of docs: one row per distinct text, in one shuffle of the texts."""
    names = docs.columns
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])
    id_, text = (f"c{names.index(x)}" for x in (id_col, text_col))
    order = F.struct(F.col(id_), *[F.col(c) for c in numbered.columns if c != id_])
    rank = F.coalesce(F.col(id_).cast("decimal(38,0)"), F.lit(None)) if keep == "max" else -F.col(id_).cast("decimal(38,0)")
    h1, h2 = content_hash(whole_text(text))
    best = numbered.groupBy(h1.alias("h1"), h2.alias("h2"), whole_text(text).alias("t")).agg(F.max(F.struct(rank.alias("rank"), order.alias("row"))).alias("best"))
    return best.select(*[F.col(f"best.row.{c}").alias(c) for c in numbered.columns]).toDF(*names)
