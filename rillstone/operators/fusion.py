"""Reciprocal rank fusion, second-level fusion, parameter grids and the final order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RRF_K = 60
NO_RANK = 1_000_000_000


def share(rank: Column, k: int = RRF_K) -> Column:
    return F.coalesce(F.lit(1.0) / (F.lit(float(k)) + rank), F.lit(0.0))


def fuse(dense: DataFrame, sparse: DataFrame, k: int = RRF_K, extra: tuple[str, ...] = ()) -> DataFrame:
    """Two ranked lists (query_id, doc_id, rank, score) into one: score, both ranks and scores, best rank, final rank.

    extra: further key columns that both lists carry.
    """
    keys = [*extra, "query_id", "doc_id"]
    a = dense.select(*keys, F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    b = sparse.select(*keys, F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    both = a.join(b, keys, "full_outer")
    both = both.withColumn("rrf_score", share(F.col("dense_rank"), k) + share(F.col("bm25_rank"), k))
    both = both.withColumn("best_rank", F.least(F.coalesce("dense_rank", F.lit(NO_RANK)), F.coalesce("bm25_rank", F.lit(NO_RANK))))
    order = Window.partitionBy(*extra, "query_id").orderBy(F.round("rrf_score", 9).desc(), "best_rank", "doc_id")
    return both.withColumn("rank", F.row_number().over(order))


def rerank(fused: DataFrame, scorer: Column, k: int = 3) -> DataFrame:
    """Order by the scorer, then fused score, then best rank, then id; the best k."""
    scored = fused.drop("rank").withColumn("rerank_score", scorer)
    order = Window.partitionBy("query_id").orderBy(F.round("rerank_score", 9).desc(), F.round("rrf_score", 9).desc(), "best_rank", "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def blend(dense: str = "dense_score", sparse: str = "bm25_score") -> Column:
    """The offline scorer in place of a cross-encoder, which needs a model file: similarity and saturated BM25, half each."""
    bm25 = F.coalesce(F.col(sparse), F.lit(0.0))
    return F.lit(0.5) * F.coalesce(F.col(dense), F.lit(0.0)) + F.lit(0.5) * bm25 / (bm25 + F.lit(10.0))


def fuse_lists(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Ranked lists of several variants of a query, (query_id, variant, doc_id, rank), into one by support and best rank."""
    merged = lists.groupBy("query_id", "doc_id").agg(
        F.sum(share(F.col("rank"), k)).alias("score"), F.count(F.lit(1)).alias("support"), F.min("rank").alias("best_rank"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("variant", "rank"))), lambda x: F.concat_ws(":", x["variant"], x["rank"])), ",").alias("ranks")
    )
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("support").desc(), "best_rank", "doc_id")
    return merged.withColumn("rank", F.row_number().over(order))


def grid(spark: SparkSession, dense: DataFrame, sparse: DataFrame, sizes: tuple[int, ...] = (5, 10, 20), k: int = RRF_K) -> DataFrame:
    """fuse() for every pair of list lengths, from lists ranked once to the longest."""
    take = lambda ranked, name: ranked.withColumn(name, F.explode(F.array(*[F.lit(n) for n in sizes]))).where(F.col("rank") <= F.col(name))
    other = lambda ranked, name: ranked.withColumn(name, F.explode(F.array(*[F.lit(n) for n in sizes])))
    return fuse(other(take(dense, "dense_k"), "bm25_k"), other(take(sparse, "bm25_k"), "dense_k"), k, ("dense_k", "bm25_k"))
