"""Turns of conversations, what a compaction keeps, and the history a router sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.functions import text as T


def with_turns(messages: DataFrame, user: str = "user") -> DataFrame:
    """messages (conv_id, turn, role, text) with turn_no: the count of user messages so far; 0 is the prefix."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("turn_no", F.sum((F.col("role") == user).cast("int")).over(order))


def compacted(messages: DataFrame, keep: int = 6, trigger: int = 9, window_tokens: int = 1_000_000, ratio: float = 0.70, summarised: Column | None = None) -> DataFrame:
    """Messages with turns, tokens, triggered, archived (turns to archive) and kept.

    Triggered by the estimated tokens or the number of turns; then all but the last keep turns are
    archived, and nothing where there are no more than that. summarised: false where writing the
    summary failed, which keeps everything.
    """
    conv = Window.partitionBy("conv_id")
    rows = with_turns(messages).withColumn("turns", F.max("turn_no").over(conv)).withColumn("tokens", F.sum(T.context_tokens(F.coalesce("text", F.lit("")))).over(conv))
    rows = rows.withColumn("triggered", (F.col("tokens") >= F.lit(ratio * window_tokens)) | (F.col("turns") >= trigger))
    done = F.col("triggered") & (summarised if summarised is not None else F.lit(True))
    rows = rows.withColumn("archived", F.when(done, F.greatest(F.col("turns") - keep, F.lit(0))).otherwise(0))
    return rows.withColumn("kept", (F.col("turn_no") == 0) | (F.col("turn_no") > F.col("archived")))


def router_history(messages: DataFrame, turns: int = 6) -> DataFrame:
    """Non-blank user and assistant messages of the last turns."""
    rows = with_turns(messages).withColumn("turns", F.max("turn_no").over(Window.partitionBy("conv_id")))
    blank = T.stripped(F.coalesce("text", F.lit(""))) == ""
    return rows.where((F.col("turn_no") > F.col("turns") - turns) & (F.col("turn_no") > 0) & F.col("role").isin("user", "assistant") & ~blank)


def flat_text(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "")
