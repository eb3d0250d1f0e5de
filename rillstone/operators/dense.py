"""Exact cosine search in blocks, and distances of neighbouring vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.operators.bm25 import ranked

#: Rows of a block on either side; a block pair is one group of at most twice as many vectors.
BLOCK = 8192
#: Scores that a task holds at once, and candidates that it scores again at once.
CELLS, AGAIN = 1 << 20, 1 << 15


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def nearest(matrix: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score to 12 places): the k best rows of every query by score to 9 places, then place.

    A product of matrices finds whatever may be among them, with room for its error; only that is summed term by term.
    """
    rough = asked @ matrix.T
    rough[np.isnan(rough)] = -np.inf
    if len(matrix) > k:
        norms = np.sqrt(np.einsum("qd,qd->q", asked, asked)), np.sqrt(np.einsum("nd,nd->n", matrix, matrix).max())
        least = np.partition(rough, len(matrix) - k, axis=1)[:, len(matrix) - k] - 1e-8 - 1e-15 * matrix.shape[1] * norms[0] * norms[1]
        q, d = np.nonzero(rough >= np.where(np.isfinite(least), least, -np.inf)[:, None])
    else:
        q, d = np.nonzero(np.ones_like(rough, bool))
    del rough
    parts = range(0, len(q), AGAIN)
    score = np.round(np.concatenate([np.einsum("nd,nd->n", asked[q[n : n + AGAIN]], matrix[d[n : n + AGAIN]], optimize=False) for n in parts]), 12)
    order = np.lexsort((d, -np.round(score, 9), q))
    q, d, score = q[order], d[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], d[place < k], score[place < k]


def topk(base: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, score, rank): the k most similar rows of base for every query.

    base: (doc_id, vector), queries: (query_id, vector), unit vectors. Both sides are dealt into blocks;
    each pair of blocks leaves k rows a query, so neither side is broadcast. A task holds both blocks and
    CELLS scores, so its memory does not grow with the tables; its work is that of all pairs.
    """
    left, right = (max(1, -(-x.count() // block)) for x in (base, queries))
    spread = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    a = base.select("doc_id", "vector", F.pmod(F.xxhash64("doc_id"), F.lit(left)).cast("int").alias("i"), spread(right, "j"))
    b = queries.select("query_id", F.col("vector").alias("asked"), F.pmod(F.xxhash64("query_id"), F.lit(right)).cast("int").alias("j"), spread(left, "i"))

    def best(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asked.empty:
            return pd.DataFrame({"query_id": np.array([], np.int64), "doc_id": np.array([], np.int64), "score": np.array([], float)})
        rows = rows.sort_values("doc_id")
        matrix, ids = np.stack(rows["vector"].to_numpy()).astype(np.float64), rows["doc_id"].to_numpy()
        wanted, names = np.stack(asked["asked"].to_numpy()), asked["query_id"].to_numpy()
        found, step = [], max(1, CELLS // len(ids))
        for start in range(0, len(names), step):
            q, d, score = nearest(matrix, wanted[start : start + step].astype(np.float64), k)
            found.append((names[start + q], ids[d], score))
        return pd.DataFrame(dict(zip(("query_id", "doc_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    pairs = a.groupBy("i", "j").cogroup(b.groupBy("i", "j"))
    return ranked(pairs.applyInPandas(best, "query_id long, doc_id long, score double"), k)


def adjacent_distances(vectors: DataFrame, group_col: str, order_col: str, vector_col: str) -> DataFrame:
    """vectors with distance = 1 - dot product to the next row of its group; null at the end."""
    order = Window.partitionBy(group_col).orderBy(order_col)
    return vectors.withColumn("distance", F.lit(1.0) - dot(F.col(vector_col), F.lead(vector_col).over(order)))
