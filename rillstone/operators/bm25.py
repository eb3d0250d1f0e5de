"""BM25 in which every document is scored where it lies.

Documents are tokenised once. A narrow table keeps, for each document, its length and the
counts of the terms that some query asks for; from it come the statistics and the scores.
A task adds up its documents' scores and keeps k of them a query, so what is shuffled are
ranked lists, never postings: a word that all documents and all queries hold costs no row.
Queries go to the tasks in blocks of QUERIES, so what is sent is bounded whatever their number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.functions import text as T
from rillstone.sources.shared import materialise

K1, B = 1.5, 0.75
#: Queries that a task scores at once, and terms that they may have in all.
QUERIES, TERMS = 2048, 1_000_000
#: Documents whose words or scores a task holds at once.
DOCUMENTS = 256

Tokens = Callable[[Column], Column]


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Tokens = T.bm25_tokens) -> DataFrame:
    """(doc_id, tokens)."""
    return docs.select(F.col(id_col).alias("doc_id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))


def spread(docs: DataFrame) -> DataFrame:
    """docs over all cores where fewer files than cores hold them: a small file is often one row group, which one task reads alone."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    few = len(docs.inputFiles()) < cores and docs.rdd.getNumPartitions() < 2 * cores
    return docs.repartition(cores) if few else docs


def idf(df: Column, n: Column) -> Column:
    return F.log(F.lit(1.0) + (n.cast("double") - df + F.lit(0.5)) / (df + F.lit(0.5)))


def idf_table(docs: DataFrame) -> DataFrame:
    """(term, df, idf) of every term."""
    rows = tokenised(docs)
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = rows.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # n is one row: a scalar subquery in all but name.
    return df.join(F.broadcast(n)).select("term", "df", F.round(idf(F.col("df"), F.col("n")), 6).alias("idf"))


def _postings(docs: DataFrame, terms: list[str], tokens: Tokens) -> DataFrame:
    """(doc_id, length, terms, counts) of every document; terms by their places in the sorted list, those that are not in it left out."""
    sent = docs.sparkSession.sparkContext.broadcast({t: n for n, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value
        for batch in (whole.slice(start, DOCUMENTS) for whole in batches for start in range(0, whole.num_rows, DOCUMENTS)):
            lengths, ids, counts = [], [], []
            for words in batch.column(1).to_pylist():
                held = Counter(filter(place.__contains__, words))
                lengths.append(len(words))
                ids.append([place[w] for w in held])
                counts.append(list(held.values()))
            columns = [batch.column(0), pa.array(lengths, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "length", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return tokenised(docs, tokens=tokens).mapInArrow(run, f"doc_id {kind}, length long, terms array<int>, counts array<int>")


class _Best:
    """The k best documents of each query so far, by score to 9 places, then id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.score, self.ids = k, np.zeros((queries, 0)), np.zeros((queries, 0), np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each document, a column for each query."""
        score = np.concatenate([self.score, scores.T], axis=1)
        every = np.concatenate([self.ids, np.broadcast_to(ids, (score.shape[0], len(ids)))], axis=1)
        order = np.lexsort((every, -np.round(score, 9)), axis=1)[:, : self.k]
        self.score, self.ids = np.take_along_axis(score, order, 1), np.take_along_axis(every, order, 1)


def _ranked_lists(held: DataFrame, asked: list[tuple[int, int, float]], weights: dict[int, float], mean: float, k: int, k1: float, b: float) -> DataFrame:
    """(query_id, doc_id, score): of every task, the k best documents of each query that share a term with it.

    asked: rows (query, term's place, weight) of one block; weights: idf by term's place.
    """
    names = sorted({q for q, _, _ in asked})
    at = {q: n for n, q in enumerate(names)}
    by_term: dict[int, list[tuple[int, float]]] = {}
    for q, term, times in asked:
        by_term.setdefault(term, []).append((at[q], times * weights.get(term, 0.0)))
    lists = {t: (np.array([q for q, _ in rows]), np.array([w for _, w in rows])) for t, rows in by_term.items()}
    sent = held.sparkSession.sparkContext.broadcast((np.array(names, np.int64), lists))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, lists = sent.value
        best = _Best(len(queries), k)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for start in range(0, batch.num_rows, DOCUMENTS):
                part = batch.slice(start, DOCUMENTS)
                scores = np.zeros((part.num_rows, len(queries)))
                for n, (length, terms, counts) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    found = [(lists[t], tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))) for t, tf in zip(terms, counts, strict=True) if t in lists]
                    if found:
                        scores[n] = np.bincount(np.concatenate([q for (q, _), _ in found]), np.concatenate([w * x for (_, w), x in found]), len(queries))
                best.add(scores, ids[start : start + DOCUMENTS])
        rows, columns = np.nonzero(best.score > 0)
        yield pa.RecordBatch.from_arrays([pa.array(queries[rows]), pa.array(best.ids[rows, columns]), pa.array(best.score[rows, columns])], names=["query_id", "doc_id", "score"])

    return held.mapInArrow(run, "query_id long, doc_id long, score double")


def matching(docs: DataFrame, queries: DataFrame, k: int, repeats: bool = False, k1: float = K1, b: float = B, tokens: Tokens = T.bm25_tokens) -> DataFrame:
    """(query_id, doc_id, score): at least the k best documents of each query that share a term with it.

    queries has query_id and text, both ids are whole numbers; repeats: a term that a query
    repeats counts repeatedly. Every document counts for the number and mean length of documents.
    """
    spark = docs.sparkSession
    each = queries.select("query_id", F.explode(tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    each = materialise(each, "asked-terms")
    docs = spread(docs.select("doc_id", "text"))
    most = each.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.sum("n")).first()
    blocks = max(1, -(-(most[0] or 0) // QUERIES), -(-(most[1] or 0) // TERMS))
    found = spark.createDataFrame([], "query_id long, doc_id long, score double")
    for block in range(blocks):
        asked = each.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        terms = sorted({r["term"] for r in asked})
        place = {t: n for n, t in enumerate(terms)}
        held = materialise(_postings(docs, terms, tokens), "postings")
        n, mean = held.agg(F.count(F.lit(1)), F.greatest(F.avg(F.col("length").cast("double")), F.lit(1.0))).first()
        df = held.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).select("t", idf(F.col("df"), F.lit(n)).alias("idf"))
        rows = [(r["query_id"], place[r["term"]], float(r["qtf"]) if repeats else 1.0) for r in asked]
        found = found.union(_ranked_lists(held, rows, {r["t"]: r["idf"] for r in df.collect()}, float(mean or 1.0), k, k1, b))
    return found


def ranked(scored: DataFrame, k: int, score: str = "score", id_col: str = "doc_id") -> DataFrame:
    """The best k of each query; ties go to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.round(score, 9).desc(), F.col(id_col))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topk(docs: DataFrame, queries: DataFrame, k: int = 5, fill: bool = True, repeats: bool = False, tokens: Tokens = T.bm25_tokens) -> DataFrame:
    """(query_id, doc_id, score, rank). fill: the first documents of the corpus, at score zero, where fewer than k match."""
    found = matching(docs, queries, k, repeats, tokens=tokens)
    if fill:
        first = docs.select("doc_id").orderBy("doc_id").limit(k)
        zero = queries.select("query_id").join(F.broadcast(first)).select("query_id", "doc_id", F.lit(0.0).alias("score"))
        found = found.union(zero).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return ranked(found, k)


def matched_tokens(hits: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """hits with the sorted terms that query and document share."""
    q = queries.select("query_id", T.bm25_tokens(F.col("text")).alias("asked"))
    d = tokenised(docs)
    return hits.join(q, "query_id").join(d, "doc_id").withColumn("matched", F.array_sort(F.array_intersect("asked", "tokens"))).drop("asked", "tokens")


def checked_request(question: str | None, k: int) -> str:
    """The question of a single search without blanks around it; a blank one or no results asked for is an error."""
    if not (question or "").strip():
        raise ValueError("the question is blank")
    if k < 1:
        raise ValueError("at least one result must be asked for")
    return question.strip()
