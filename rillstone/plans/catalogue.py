"""The named queries of the library and the SQL that each is checked against.

Every query reads whole tables. Floats are rounded to 6 places, and every ranking ends in an id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstone.functions import text as T
from rillstone.operators import bm25, chunking, conversation, dense, fusion, lexicon, metrics, planning, rules
from rillstone.plans import sqlguard
from rillstone.streaming import events as stream_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its oracle."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(name: str):  # noqa: ANN201
    return F.round(name, 6).alias(name)


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# -- SQL fragments -----------------------------------------------------------------------------


def tok(column: str) -> str:
    clean = rf"regexp_replace(regexp_replace(regexp_replace({column}, '(?i)\[Image(?: omitted)?:\s*[^\]]+\]', ' ', 'g'), 'https?://\S+', ' ', 'g'), '(?m)^Section:\s*', '', 'g')"
    return rf"regexp_extract_all(lower({clean}), '\d+(?:\.\d+)?%?|[A-Za-z][A-Za-z0-9]*|[\x{{4e00}}-\x{{9fff}}]+')"


COUNT_TOK = r"regexp_extract_all(coalesce(text, ''), '[\x{4e00}-\x{9fff}]|[A-Za-z0-9_]+|[\t\f\v \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|\n|[^\p{L}\p{N}\p{M}\p{Pc}\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')"
STRIP = r"regexp_replace({}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')"


def bm25_sql(weight: str = "1.0::DOUBLE") -> str:
    return f"""
    tok AS (SELECT doc_id, {tok("coalesce(text, '')")} AS tokens FROM documents),
    st AS (SELECT count(*)::DOUBLE AS n, greatest(avg(len(tokens)::DOUBLE), 1.0::DOUBLE) AS mean FROM tok),
    qt AS (SELECT query_id, term, count(*)::DOUBLE AS qtf FROM (SELECT item_id AS query_id, unnest({tok("text")}) AS term FROM benchmark) GROUP BY 1, 2),
    post AS (SELECT doc_id, term, length, count(*)::DOUBLE AS tf FROM (SELECT doc_id, len(tokens)::DOUBLE AS length, unnest(tokens) AS term FROM tok) GROUP BY 1, 2, 3),
    dfs AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY 1),
    sc AS (SELECT query_id, doc_id, sum({weight} * ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS score
           FROM qt JOIN post USING (term) JOIN dfs USING (term), st GROUP BY 1, 2),
    filled AS (SELECT query_id, doc_id, max(score) AS score FROM (
                 SELECT * FROM sc UNION ALL
                 SELECT item_id, doc_id, 0.0::DOUBLE FROM benchmark, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 20)) GROUP BY 1, 2),
    sparse AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM filled)"""


DENSE_SQL = """
    pairs AS (SELECT b.item_id AS query_id, e.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 12) AS score
              FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings e),
    dense AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM pairs)"""


def fused_sql(dense_k: int = 10, sparse_k: int = 5) -> str:
    return f"""{bm25_sql()}, {DENSE_SQL},
    both_ AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.doc_id, s.doc_id) AS doc_id, d.rank AS dense_rank, d.score AS dense_score, s.rank AS bm25_rank, s.score AS bm25_score
              FROM (SELECT * FROM dense WHERE rank <= {dense_k}) d FULL JOIN (SELECT * FROM sparse WHERE rank <= {sparse_k}) s ON d.query_id = s.query_id AND d.doc_id = s.doc_id),
    scored AS (SELECT *, coalesce(1.0::DOUBLE / (60 + dense_rank), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0.0::DOUBLE) AS rrf_score,
               least(coalesce(dense_rank, 1000000000), coalesce(bm25_rank, 1000000000)) AS best_rank FROM both_),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC, best_rank, doc_id) AS rank FROM scored)"""


GOLD_SQL = """hits AS (SELECT s.query_id, s.doc_id, s.rank, contains(d.text, b.text) AS gold FROM (SELECT * FROM sparse WHERE rank <= 10) s JOIN documents d ON d.doc_id = s.doc_id JOIN benchmark b ON b.item_id = s.query_id),
    gr AS (SELECT query_id, min(CASE WHEN gold THEN rank END) AS gold_rank FROM hits GROUP BY 1)"""


# -- retrieval ---------------------------------------------------------------------------------


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _sparse(spark: SparkSession, sf_dir: str, k: int, repeats: bool = False, tokens=T.bm25_tokens) -> DataFrame:  # noqa: ANN001
    return bm25.topk(read(spark, sf_dir, "documents"), _asked(spark, sf_dir), k, repeats=repeats, tokens=tokens)


def _dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    asked = read(spark, sf_dir, "benchmark").join(vectors, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"))
    return dense.topk(vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), asked, k)


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(_dense(spark, sf_dir, 10), _sparse(spark, sf_dir, 5))


@query(f"WITH {bm25_sql()} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM sparse WHERE rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(_sparse(spark, sf_dir, 5).select("query_id", "doc_id", "rank", r6("score")), "rank")


@query(f"WITH {bm25_sql('qtf')} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM sparse WHERE rank <= 5")
def bm25_repeat_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(_sparse(spark, sf_dir, 5, repeats=True).select("query_id", "doc_id", "rank", r6("score")), "rank")


@query(f"""WITH {bm25_sql()}, h AS (SELECT * FROM sparse WHERE rank <= 5)
    SELECT h.query_id, h.doc_id, array_to_string(list_sort(list_distinct(list_intersect({tok("b.text")}, t.tokens))), ' ') AS matched
    FROM h JOIN benchmark b ON b.item_id = h.query_id JOIN tok t ON t.doc_id = h.doc_id""")
def bm25_matched_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = bm25.matched_tokens(_sparse(spark, sf_dir, 5), read(spark, sf_dir, "documents"), _asked(spark, sf_dir))
    return hits.select("query_id", "doc_id", F.array_join("matched", " ").alias("matched"))


@query(f"""WITH tok AS (SELECT doc_id, {tok("coalesce(text, '')")} AS tokens FROM documents), n AS (SELECT count(*)::DOUBLE AS n FROM documents)
    SELECT term, count(*) AS df, round(ln(1.0::DOUBLE + (any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 6) AS idf
    FROM (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM tok), n GROUP BY term""")
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.idf_table(read(spark, sf_dir, "documents"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 12) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
    SELECT query_id, doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def dense_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20, against all."""
    vectors = read(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = dense.topk(vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), asked, 10)
    return longs(found.select("query_id", "doc_id", "rank", r6("score")), "rank")


@query(f"WITH {fused_sql()} SELECT query_id, doc_id, rank, round(rrf_score, 6) AS rrf_score, dense_rank, bm25_rank, best_rank FROM fused")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _fused(spark, sf_dir)
    return longs(found.select("query_id", "doc_id", "rank", r6("rrf_score"), "dense_rank", "bm25_rank", "best_rank"), "rank", "dense_rank", "bm25_rank", "best_rank")


@query(f"""WITH {fused_sql()}, re AS (SELECT *, 0.5::DOUBLE * coalesce(dense_score, 0.0) + 0.5::DOUBLE * coalesce(bm25_score, 0.0) / (coalesce(bm25_score, 0.0) + 10.0::DOUBLE) AS rerank_score FROM fused),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, round(rrf_score, 9) DESC, best_rank, doc_id) AS place FROM re)
    SELECT query_id, doc_id, place AS rank, round(rerank_score, 6) AS rerank_score, round(rrf_score, 6) AS rrf_score FROM o WHERE place <= 3""")
def hybrid_rerank_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fusion.rerank(_fused(spark, sf_dir), fusion.blend(), 3)
    return longs(found.select("query_id", "doc_id", "rank", r6("rerank_score"), r6("rrf_score")), "rank")


@query(f"""WITH {bm25_sql()}, rep AS (SELECT query_id, doc_id, sum(qtf * ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS score
           FROM qt JOIN post USING (term) JOIN dfs USING (term), st GROUP BY 1, 2),
    rr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM rep), {DENSE_SQL},
    lists AS (SELECT query_id, 'distinct' AS variant, doc_id, rank FROM sparse WHERE rank <= 10 UNION ALL SELECT query_id, 'repeated', doc_id, rank FROM rr WHERE rank <= 10 UNION ALL SELECT query_id, 'dense', doc_id, rank FROM dense WHERE rank <= 10),
    m AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, count(*) AS support, min(rank) AS best_rank FROM lists GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, support DESC, best_rank, doc_id) AS rank FROM m)
    SELECT query_id, doc_id, rank, round(score, 6) AS score, support, best_rank FROM o WHERE rank <= 15""")
def multi_query_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda df, name: df.select("query_id", F.lit(name).alias("variant"), "doc_id", "rank")
    docs, asked = read(spark, sf_dir, "documents"), _asked(spark, sf_dir)
    repeated = bm25.topk(docs, asked, 10, fill=False, repeats=True)
    lists = part(_sparse(spark, sf_dir, 10), "distinct").union(part(repeated, "repeated")).union(part(_dense(spark, sf_dir, 10), "dense"))
    found = fusion.fuse_lists(lists).where("rank <= 15")
    return longs(found.select("query_id", "doc_id", "rank", r6("score"), "support", "best_rank"), "rank", "best_rank")


@query(f"""WITH {bm25_sql()}, {DENSE_SQL}, ks AS (SELECT unnest([5, 10, 20]) AS k),
    d AS (SELECT dense.*, a.k AS dense_k, b.k AS bm25_k FROM dense, ks a, ks b WHERE rank <= a.k), s AS (SELECT sparse.*, a.k AS dense_k, b.k AS bm25_k FROM sparse, ks a, ks b WHERE rank <= b.k)
    SELECT coalesce(d.dense_k, s.dense_k)::BIGINT AS dense_k, coalesce(d.bm25_k, s.bm25_k)::BIGINT AS bm25_k, count(*) AS pool, round(avg(coalesce(1.0::DOUBLE / (60 + d.rank), 0.0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0.0)), 6) AS mean_rrf
    FROM d FULL JOIN s ON d.query_id = s.query_id AND d.doc_id = s.doc_id AND d.dense_k = s.dense_k AND d.bm25_k = s.bm25_k GROUP BY 1, 2""")
def grid_dense_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fusion.grid(spark, _dense(spark, sf_dir, 20), _sparse(spark, sf_dir, 20))
    return longs(found.groupBy("dense_k", "bm25_k").agg(F.count(F.lit(1)).alias("pool"), F.round(F.avg("rrf_score"), 6).alias("mean_rrf")), "dense_k", "bm25_k")


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, gold_rank): where among its ten best documents the first lies that holds the text word for word."""
    hits = _sparse(spark, sf_dir, 10)
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    held = hits.join(docs, "doc_id").join(_asked(spark, sf_dir), "query_id").where(F.contains("body", "text")).select("query_id", "doc_id")
    asked = _asked(spark, sf_dir).select("query_id")
    return asked.join(metrics.gold_ranks(hits, held), "query_id", "left")


@query(f"""WITH {bm25_sql()}, {GOLD_SQL} SELECT count(*) AS questions, round(avg((gold_rank IS NOT NULL)::INT), 6) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / gold_rank, 0.0)), 6) AS mrr,
    round(avg((coalesce(gold_rank, 0) = 1)::INT), 6) AS gold_top1 FROM gr""")
def hit_mrr_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(spark, sf_dir).agg(*metrics.metric_block())


@query(f"""WITH {bm25_sql()}, {GOLD_SQL}, x AS (SELECT gr.*, CASE WHEN length(b.text) > 250 THEN 'long' ELSE 'short' END AS kind, CASE WHEN b.item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS half FROM gr JOIN benchmark b ON b.item_id = gr.query_id)
    SELECT coalesce(kind, half, 'overall') AS level, count(*) AS questions, round(avg((gold_rank IS NOT NULL)::INT), 6) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / gold_rank, 0.0)), 6) AS mrr,
    round(avg((coalesce(gold_rank, 0) = 1)::INT), 6) AS gold_top1 FROM x GROUP BY GROUPING SETS ((), (kind), (half))""")
def metrics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = _asked(spark, sf_dir).select("query_id", F.when(F.length("text") > 250, "long").otherwise("short").alias("kind"), F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd").alias("half"))
    return metrics.grouped_metrics(_gold(spark, sf_dir).join(kinds, "query_id"), "kind", "half").select("level", "questions", "hit_rate", "mrr", "gold_top1")


# -- labels and metrics ------------------------------------------------------------------------


@query("""SELECT d.source, count(*) AS n, round(avg((quality + toxic >= 1)::INT), 6) AS loose, round(avg((quality + toxic = 2)::INT), 6) AS strict
    FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1""")
def precision_loose_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    label = F.col("quality") + F.col("toxic")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(metrics.precision(label), 6).alias("loose"), F.round(metrics.precision(label, strict=True), 6).alias("strict"))


@query("""SELECT a.x AS actual, p.x AS predicted, count(l.doc_id) AS n FROM (SELECT unnest([0, 1])::INT AS x) a CROSS JOIN (SELECT unnest([0, 1])::INT AS x) p LEFT JOIN labels l ON l.quality = a.x AND l.toxic = p.x GROUP BY 1, 2""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(longs(read(spark, sf_dir, "labels"), "quality", "toxic").select(F.col("quality").cast("int"), F.col("toxic").cast("int")), "quality", "toxic", [0, 1])


@query("""WITH c AS (SELECT x::INT AS label, count(*) FILTER (quality = x AND toxic = x)::DOUBLE AS tp, count(*) FILTER (toxic = x)::DOUBLE AS said, count(*) FILTER (quality = x)::DOUBLE AS is_ FROM labels, (SELECT unnest([0, 1]) AS x) GROUP BY x),
    m AS (SELECT *, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS p, CASE WHEN is_ > 0 THEN tp / is_ ELSE 0 END AS r FROM c)
    SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, is_::BIGINT AS support FROM m""")
def prf_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_metrics(read(spark, sf_dir, "labels"), "quality", "toxic", [0, 1])


@query("SELECT 'lang' AS column_name, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.value_counts(read(spark, sf_dir, "documents"), "lang", "source")


@query(f"""WITH {bm25_sql()}, kw AS (SELECT item_id, list_distinct({tok("text")}) AS words, text FROM benchmark), t AS (SELECT s.query_id, lower(d.text) AS body FROM sparse s JOIN documents d ON d.doc_id = s.doc_id WHERE rank = 1)
    SELECT item_id AS query_id, len(list_filter(words, lambda w: contains(body, w)))::BIGINT AS found, len(words)::BIGINT AS total, CASE WHEN len(words) > 0 THEN round(len(list_filter(words, lambda w: contains(body, w)))::DOUBLE / len(words), 3) ELSE 0 END AS coverage
    FROM kw JOIN t ON t.query_id = kw.item_id""")
def keyword_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _sparse(spark, sf_dir, 1)
    bodies = read(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("body"))
    rows = top.select("query_id", "doc_id").join(bodies, "doc_id").join(_asked(spark, sf_dir), "query_id").withColumn("words", F.array_distinct(T.bm25_tokens(F.col("text"))))
    found, _, share = metrics.keyword_coverage(F.col("body"), F.col("words"))
    return rows.select("query_id", F.size(found).cast("long").alias("found"), F.size("words").cast("long").alias("total"), share.alias("coverage"))


@query("""WITH g AS (SELECT source, avg(quality) AS recall, avg(toxic) AS hit, avg((quality = 1 AND toxic = 0)::INT) AS prec, count(*)::DOUBLE AS pool FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1),
    s AS (SELECT source, 0.5::DOUBLE * recall + 0.2::DOUBLE * hit + 0.25::DOUBLE * prec - 0.05::DOUBLE * pool / 40.0::DOUBLE AS score FROM g)
    SELECT source, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, source) AS place FROM s""")
def combined_score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("double")
    each = rows.groupBy("source").agg(F.avg("quality").alias("recall"), F.avg("toxic").alias("hit"), F.avg(good).alias("prec"), F.count(F.lit(1)).cast("double").alias("pool"))
    scored = each.select("source", metrics.combined_score(F.col("recall"), F.col("hit"), F.col("prec"), F.col("pool")).alias("score"))
    return scored.select("source", r6("score"), F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "source")).cast("long").alias("place"))


@query("""WITH c AS (SELECT doc_id % 7 AS query_id, doc_id, quality AS label, 'a' || quality AS reason, 0 AS n FROM labels UNION ALL SELECT doc_id % 7, doc_id, toxic, 'b' || toxic, 1 FROM labels UNION ALL SELECT doc_id % 7, doc_id, 1, 'c1', 2 FROM labels),
    f AS (SELECT query_id, doc_id, arg_min(label, n) AS kept FROM c GROUP BY 1, 2)
    SELECT c.query_id, c.doc_id, max(kept)::INT AS label, arg_max(reason, n) FILTER (label = kept) AS reason, count(*) FILTER (label <> kept) AS conflicts FROM c JOIN f ON c.query_id = f.query_id AND c.doc_id = f.doc_id GROUP BY 1, 2""")
def judge_cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three caches of judgements, made from the label columns and a constant."""
    rows = read(spark, sf_dir, "labels").select((F.col("doc_id") % 7).alias("query_id"), "doc_id", F.col("quality").cast("int"), F.col("toxic").cast("int"))
    cache = lambda label, mark: rows.select("query_id", "doc_id", label.alias("label"), F.concat(F.lit(mark), label.cast("string")).alias("reason"))
    return metrics.merge_caches(cache(F.col("quality"), "a"), cache(F.col("toxic"), "b"), cache(F.lit(1), "c"))


@query("""WITH q AS (SELECT l.doc_id AS id, l.doc_id AS row_no, d.text AS question, l.doc_id AS doc_id, CASE WHEN l.quality = 0 THEN '' ELSE d.text END AS evidence FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
    k AS (SELECT *, lower(regexp_replace(question, '[^\\p{L}\\p{N}\\p{M}]+', '', 'g')) AS key FROM q), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY row_no) AS n, first_value(id) OVER (PARTITION BY key ORDER BY row_no) AS first FROM k)
    SELECT id, 'duplicate_question' AS problem, first::VARCHAR AS detail FROM n WHERE n > 1 UNION ALL SELECT id, 'missing_field', 'evidence' FROM q WHERE trim(evidence) = '' UNION ALL SELECT id, 'stale_evidence', q.doc_id::VARCHAR FROM q JOIN documents d ON d.doc_id = q.doc_id WHERE d.text <> evidence""")
def static_data_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions made from labelled documents; those of label 0 have lost their evidence."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = read(spark, sf_dir, "labels").join(docs, "doc_id")
    questions = rows.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("row_no"), F.col("text").alias("question"), "doc_id", F.when(F.col("quality") == 0, "").otherwise(F.col("text")).alias("evidence"))
    return metrics.audit(questions, docs, ["evidence"])


@query("SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 25")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.seeded_sample(read(spark, sf_dir, "documents").select("doc_id", "lang"), 25, 42, "doc_id")


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS turn FROM documents), p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn, doc_id) AS place FROM t)
    SELECT doc_id, lang, source FROM p WHERE place <= CASE lang WHEN 'en' THEN 3 WHEN 'fr' THEN 3 WHEN 'de' THEN 3 WHEN 'es' THEN 1 END""")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return metrics.quota_sample(rows, {"en": 3, "fr": 3, "de": 3, "es": 1}, "lang", "source", "doc_id")


@query("SELECT l_returnflag, round(avg(l_extendedprice), 6) AS mean, round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 6) AS median, round(quantile_cont(l_extendedprice::DOUBLE, 0.95), 6) AS p95 FROM lineitem GROUP BY 1")
def timing_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.grouped_percentiles(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", {"median": 0.5, "p95": 0.95})
    return found.select("l_returnflag", r6("mean"), r6("median"), r6("p95"))


# -- chunks ------------------------------------------------------------------------------------

FIXED_SQL = f"""t AS (SELECT doc_id, {COUNT_TOK} AS tokens FROM documents),
    c AS (SELECT doc_id, i * 320 AS start_token, least(i * 320 + 400, len(tokens)) AS end_token, {STRIP.format("array_to_string(tokens[i * 320 + 1 : i * 320 + 400], '')")} AS text
          FROM (SELECT *, unnest(range(greatest(ceil((len(tokens) - 80) / 320.0), 1)::BIGINT)) AS i FROM t WHERE len(tokens) > 0)),
    fixed AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_token) - 1 AS chunk_index, start_token, end_token, end_token - start_token AS token_count, text FROM c WHERE text <> '')"""


@query(f"WITH {FIXED_SQL} SELECT doc_id, chunk_index, start_token, end_token, token_count, sha256(text) AS text_sha256 FROM fixed")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.fixed_chunks(read(spark, sf_dir, "documents"))
    return longs(found.select("doc_id", "chunk_index", "start_token", "end_token", "token_count", F.sha2("text", 256).alias("text_sha256")), "chunk_index", "start_token", "end_token", "token_count")


@query(f"WITH {FIXED_SQL} SELECT count(*) AS chunks, min(token_count) AS min_tokens, max(token_count) AS max_tokens, round(avg(token_count), 2) AS avg_tokens FROM fixed")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.statistics(chunking.fixed_chunks(read(spark, sf_dir, "documents")))


@query(f"""WITH {FIXED_SQL}, x AS (SELECT f.*, d.source, lag(d.source) OVER w AS before, lag(token_count) OVER w AS tokens_before FROM fixed f JOIN documents d ON d.doc_id = f.doc_id WINDOW w AS (PARTITION BY f.doc_id ORDER BY chunk_index))
    SELECT count(*) FILTER (before = source) AS transitions, count(*) FILTER (before = source AND tokens_before >= 340) AS full_transitions FROM x""")
def chunk_boundary_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return chunking.boundary_quality(chunking.fixed_chunks(docs).join(docs.select("doc_id", "source"), "doc_id"), "source", 400)


@query(rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?。！？])\s*', '\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS parts FROM documents)
    SELECT doc_id, len(parts)::BIGINT AS sentences, sha256(array_to_string(parts, '|')) AS sentences_sha256 FROM s""")
def sentence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", T.sentences(F.coalesce("text", F.lit(""))).alias("parts"))
    return rows.select("doc_id", F.size("parts").cast("long").alias("sentences"), F.sha2(F.array_join("parts", "|"), 256).alias("sentences_sha256"))


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')) AS line FROM documents), h AS (SELECT doc_id, count(*) FILTER (regexp_matches({STRIP.format('line')}, '^#{{1,6}}\s+.+$')) AS headings, count(*) FILTER ({STRIP.format('line')} <> '') AS filled FROM l GROUP BY 1)
    SELECT doc_id, headings, filled FROM h""")
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking._lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.groupBy("doc_id").agg(F.count("heading").alias("headings"), F.count_if(T.stripped(F.col("line")) != "").alias("filled"))


@query()
def section_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.document_blocks(read(spark, sf_dir, "documents"))
    return longs(found.select("doc_id", "section_no", "section", "block_no", "type", F.length("text").alias("n_chars")), "section_no", "block_no", "n_chars")


@query()
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.document_semantic_chunks(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "chunk_index", "section", "token_count", F.array_join("block_types", ",").alias("block_types"), r6("boundary_distance"), F.sha2("text", 256).alias("text_sha256"))


@query()
def structure_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.document_structure_chunks(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "chunk_index", "section", "token_count", F.array_join("block_types", ",").alias("block_types"), F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH {FIXED_SQL} SELECT f.doc_id, chunk_index, sha256(d.source || '|Document|' || chunk_index || '|' || substr(sha256(f.text), 1, 16)) AS chunk_id FROM fixed f JOIN documents d ON d.doc_id = f.doc_id")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = chunking.fixed_chunks(docs).join(docs.select("doc_id", "source"), "doc_id").withColumn("section", F.lit("Document"))
    return longs(rows.select("doc_id", "chunk_index", chunking.chunk_id().alias("chunk_id")), "chunk_index")


@query("""WITH RECURSIVE a AS (SELECT doc_id // 1000 AS k, sha256(string_agg(sha256(doc_id || chr(10) || coalesce(text, '')), '' ORDER BY doc_id)) AS d, count(*) AS n FROM documents GROUP BY 1),
    b AS (SELECT k // 1000 AS k, sha256(string_agg(d, '' ORDER BY k)) AS d, sum(n)::BIGINT AS n FROM a GROUP BY 1)
    SELECT n AS chunks, d AS fingerprint FROM a WHERE (SELECT max(doc_id) FROM documents) < 1000 UNION ALL SELECT n, d FROM b WHERE (SELECT max(doc_id) FROM documents) >= 1000""")
def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.corpus_fingerprint(read(spark, sf_dir, "documents"))


# -- text --------------------------------------------------------------------------------------


@query(rf"""WITH a AS (SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS t FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '(?m)^#{{1,6}}\s*$', '', 'g') AS t FROM a),
    c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?m)^(#{{1,6}})\s+', '\1 ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM b)
    SELECT page_id, length({STRIP.format('t')})::BIGINT AS n_chars, sha256({STRIP.format('t')}) AS text_sha256 FROM c""")
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"))


@query(rf"""WITH a AS (SELECT doc_id, {STRIP.format(r"regexp_replace(text, '[\s\x{a0}]+', ' ', 'g')".replace('{', '{{').replace('}', '}}')).replace('{{', '{').replace('}}', '}')} AS t FROM documents)
    SELECT doc_id, CASE WHEN length(t) > 420 THEN rtrim(substr(t, 1, 420)) || '...' ELSE t END AS preview FROM a""")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query(r"""WITH k AS (SELECT doc_id, lower(regexp_replace(text, '[^\p{L}\p{N}\p{M}]+', '', 'g')) AS key FROM documents)
    SELECT doc_id, first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS first FROM k) WHERE doc_id <> first""")
def normalised_question_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", T.question_key(F.col("text")).alias("key")).withColumn("hash", F.sha2("key", 256)).drop("key")
    firsts = rows.groupBy("hash").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(firsts, "hash").where("doc_id <> first").select("doc_id", "first")


@query()
def ascii_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(T.ascii_terms(F.coalesce("text", F.lit("")))).alias("term"))
    each = rows.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents"))


# -- lexicon -----------------------------------------------------------------------------------

GRAMS_SQL = r"""r AS (SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), 'https?://\S+', ' ', 'g')), '[a-z]{2,}')) AS run FROM documents) GROUP BY 1),
    p AS (SELECT run, n, unnest(range(1, length(run) + 1)) AS pos FROM r), g0 AS (SELECT run, n, pos, unnest(range(1, least(8, length(run) - pos + 1) + 1)) AS len FROM p),
    g AS (SELECT substr(run, pos, len) AS term, n, CASE WHEN pos = 1 THEN '^' ELSE substr(run, pos - 1, 1) END AS before, CASE WHEN pos + len > length(run) THEN '$' ELSE substr(run, pos + len, 1) END AS after FROM g0),
    cnt AS (SELECT term, sum(n)::BIGINT AS frequency FROM g GROUP BY 1)"""
STATS_SQL = f"""{GRAMS_SQL},
    eb AS (SELECT term, log2(sum(m)) - sum(m * log2(m)) / sum(m) AS h FROM (SELECT term, before, sum(n)::DOUBLE AS m FROM g WHERE length(term) >= 2 GROUP BY 1, 2) GROUP BY 1),
    ea AS (SELECT term, log2(sum(m)) - sum(m * log2(m)) / sum(m) AS h FROM (SELECT term, after, sum(n)::DOUBLE AS m FROM g WHERE length(term) >= 2 GROUP BY 1, 2) GROUP BY 1),
    be AS (SELECT term, greatest(0.0, least(eb.h, ea.h)) AS boundary_entropy FROM eb JOIN ea USING (term)),
    tot AS (SELECT sum(frequency)::DOUBLE AS total FROM cnt WHERE length(term) = 1), fr AS (SELECT * FROM cnt WHERE frequency >= 4 AND length(term) >= 2),
    sp AS (SELECT term, frequency, substr(term, 1, k) AS a, substr(term, k + 1) AS b FROM (SELECT *, unnest(range(1, length(term))) AS k FROM fr)),
    pm AS (SELECT sp.term, min(log2(sp.frequency::DOUBLE * total / (x.frequency::DOUBLE * y.frequency::DOUBLE))) AS minimum_pmi FROM sp JOIN cnt x ON x.term = sp.a JOIN cnt y ON y.term = sp.b, tot GROUP BY 1)"""


@query(f"WITH {GRAMS_SQL} SELECT term, frequency FROM cnt WHERE frequency >= 4 AND length(term) >= 2")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexicon.counts(lexicon.grams(lexicon.runs(read(spark, sf_dir, "documents"))))
    return found.where((F.col("frequency") >= 4) & (F.length("term") >= 2))


@query(f"WITH {STATS_SQL} SELECT term, round(boundary_entropy, 6) AS boundary_entropy FROM be JOIN fr USING (term)")
def boundary_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lexicon.grams(lexicon.runs(read(spark, sf_dir, "documents")))
    frequent = lexicon.counts(cut).where((F.col("frequency") >= 4) & (F.length("term") >= 2))
    return lexicon.boundary_entropy(cut).join(frequent, "term").select("term", r6("boundary_entropy"))


@query(f"WITH {STATS_SQL} SELECT term, round(minimum_pmi, 6) AS minimum_pmi FROM pm")
def pmi_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = lexicon.counts(lexicon.grams(lexicon.runs(read(spark, sf_dir, "documents"))))
    return lexicon.minimum_pmi(every.where((F.col("frequency") >= 4) & (F.length("term") >= 2)), every).select("term", r6("minimum_pmi"))


LEXICON_SQL = f"""{STATS_SQL}, ok AS (SELECT term, frequency, minimum_pmi, boundary_entropy FROM fr JOIN be USING (term) JOIN pm USING (term)
      WHERE term NOT IN ('http', 'https', 'www', 'com') AND length(replace(term, substr(term, 1, 1), '')) > 0 AND CASE WHEN length(term) = 2 THEN frequency >= 8 AND minimum_pmi >= 2.5 AND boundary_entropy >= 0.35 ELSE minimum_pmi >= 3.0 AND boundary_entropy >= 0.15 END),
    dr AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), 'https?://\\S+', ' ', 'g')), '[a-z]{{2,}}')) AS run FROM documents),
    rt AS (SELECT DISTINCT g0.run, ok.term FROM g0 JOIN ok ON ok.term = substr(g0.run, g0.pos, g0.len)), dc AS (SELECT term, count(DISTINCT doc_id) AS document_count FROM rt JOIN dr USING (run) GROUP BY 1),
    lex AS (SELECT ok.*, document_count, log2(frequency + 1.0::DOUBLE) * 5 + greatest(minimum_pmi, 0.0) * 1.5 + boundary_entropy * 2 + least(document_count, 5) * 1.5 AS score FROM ok JOIN dc USING (term))"""


@query(f"WITH {LEXICON_SQL} SELECT term, frequency, document_count, round(score, 6) AS score FROM lex ORDER BY round(score, 9) DESC, term LIMIT 300")
def lexicon_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexicon.top_terms(read(spark, sf_dir, "documents"), 300)
    return found.orderBy(F.round("score", 9).desc(), "term").select("term", "frequency", "document_count", r6("score"))


def _kept_sql() -> str:
    levels = ["k8 AS (SELECT term, frequency FROM lex WHERE length(term) >= 8)"]
    for n in range(7, 1, -1):
        levels.append(f"k{n} AS (SELECT * FROM k{n + 1} UNION ALL SELECT term, frequency FROM lex l WHERE length(term) = {n} AND NOT EXISTS (SELECT 1 FROM k{n + 1} b WHERE length(b.term) BETWEEN {n + 1} AND {n + 2} AND contains(b.term, l.term) AND b.frequency >= l.frequency * 0.85::DOUBLE))")
    return ", ".join(levels)


@query(f"WITH {LEXICON_SQL}, {_kept_sql()} SELECT term, frequency FROM k2")
def fragment_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexicon.valid_terms(read(spark, sf_dir, "documents")).select("term", "frequency")
    return lexicon.without_fragments(found, longest=lexicon.MAX_LENGTH)


@query("""WITH t AS (SELECT DISTINCT lower(p_name) AS term FROM part UNION SELECT DISTINCT lower(p_brand) FROM part UNION SELECT DISTINCT lower(substr(p_brand, 1, 6)) FROM part)
    SELECT a.term AS shorter, b.term AS longer FROM t a JOIN t b ON contains(b.term, a.term) AND a.term <> b.term""")
def nested_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    names = part.select(F.lower("p_name").alias("term")).union(part.select(F.lower("p_brand"))).union(part.select(F.lower(F.substring("p_brand", 1, 6)))).distinct()
    return lexicon.nested_pairs(names)


# -- conversations -----------------------------------------------------------------------------

TURNS_SQL = "w AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS turn_no FROM conversations)"


@query(f"WITH {TURNS_SQL} SELECT conv_id, turn, role, turn_no FROM w")
def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.with_turns(read(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "turn_no")


@query(f"""WITH {TURNS_SQL}, m AS (SELECT *, max(turn_no) OVER (PARTITION BY conv_id) AS turns FROM w), a AS (SELECT *, CASE WHEN turns >= 3 THEN greatest(turns - 2, 0) ELSE 0 END AS archived FROM m)
    SELECT conv_id, turn, turns, archived, turn_no = 0 OR turn_no > archived AS kept FROM a""")
def conversation_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keeps 2 turns and triggers at 3: these conversations are short."""
    found = conversation.compacted(read(spark, sf_dir, "conversations"), keep=2, trigger=3)
    return longs(found.select("conv_id", "turn", "turns", "archived", "kept"), "archived")


@query(f"""WITH {TURNS_SQL}, m AS (SELECT *, max(turn_no) OVER (PARTITION BY conv_id) AS turns FROM w)
    SELECT conv_id, turn, role, text FROM m WHERE turn_no > turns - 2 AND turn_no > 0 AND role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> ''""")
def router_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.router_history(read(spark, sf_dir, "conversations"), turns=2).select("conv_id", "turn", "role", "text")


@query("""WITH x AS (SELECT vec_id, label, 1.0::DOUBLE - list_dot_product(embedding::DOUBLE[], lead(embedding) OVER (PARTITION BY label ORDER BY vec_id)::DOUBLE[]) AS distance FROM embeddings)
    SELECT vec_id, label, round(distance, 6) AS distance FROM x""")
def adjacent_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.adjacent_distances(read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").select("vec_id", "label", r6("distance"))


# -- planning ----------------------------------------------------------------------------------


@query("""WITH k AS (SELECT p_partkey AS task, 0 AS rule, p_brand AS keyword, 'brand' AS keyword_type, 'p_brand' AS source_field, TRUE AS required FROM part UNION ALL SELECT p_partkey, 1, p_type, 'type', 'p_type', FALSE FROM part UNION ALL SELECT p_partkey, 2, p_name, 'product', 'p_name', FALSE FROM part),
    f AS (SELECT *, row_number() OVER (PARTITION BY task, lower(keyword) ORDER BY rule) AS n FROM k WHERE trim(keyword) <> '')
    SELECT task, keyword, keyword_type, source_field, required, row_number() OVER (PARTITION BY task ORDER BY rule) AS position FROM f WHERE n = 1""")
def keyword_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules_ = [("p_brand", "brand", True), ("p_type", "type", False), ("p_name", "product", False)]
    return longs(planning.keyword_plan(read(spark, sf_dir, "part"), rules_, "p_partkey"), "position")


@query("""WITH p AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS p, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
    SELECT p_partkey, p_brand, ((p * 3 - 1) // n + 1)::BIGINT AS batch_no FROM p""")
def keyword_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(planning.batches(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), 3, "p_brand", "p_partkey"), "batch_no")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.latest(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


STATUS_SQL = """st AS (SELECT user_id AS keyword, CASE arg_max(event_type, event_id) WHEN 'click' THEN 'success' WHEN 'view' THEN 'partial' WHEN 'purchase' THEN 'skipped' ELSE 'failed' END AS status, CASE WHEN max(event_id) % 3 = 0 THEN '7d' ELSE '30d' END AS period, (max(event_id) % 2)::INT AS tabs FROM events GROUP BY 1),
    kw AS (SELECT DISTINCT c_custkey AS keyword FROM customer)"""


@query(f"""WITH {STATUS_SQL}, j AS (SELECT kw.keyword, status, period, tabs, status = 'success' OR (status = 'partial' AND tabs >= 1) AS done FROM kw LEFT JOIN st ON st.keyword = kw.keyword)
    SELECT keyword, CASE WHEN done AND period = '30d' THEN 'usable' WHEN status = 'skipped' THEN 'terminal' ELSE 'collect' END AS state,
    CASE WHEN status IS NULL THEN 'missing' WHEN done AND period <> '30d' THEN 'wrong_period' WHEN status = 'partial' AND NOT done THEN 'no_tabs' WHEN status = 'failed' THEN 'failed' ELSE '' END AS reason FROM j""")
def readiness_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as keywords; the state of a keyword is made from its user's last event."""
    last = planning.latest(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")
    status = F.when(F.col("event_type") == "click", "success").when(F.col("event_type") == "view", "partial").when(F.col("event_type") == "purchase", "skipped").otherwise("failed")
    rows = last.select(F.col("user_id").alias("keyword"), status.alias("status"), F.when(F.col("event_id") % 3 == 0, "7d").otherwise("30d").alias("requested_period"), (F.col("event_id") % 2).alias("succeeded_tabs"), F.lit("not_indexed").alias("skip_reason"))
    return planning.readiness(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("keyword")), rows, "30d")


@query("""WITH b AS (SELECT * FROM (VALUES ('7d', 5, 9), ('14d', 12, 16), ('30d', 27, 33), ('6m', 170, 190)) AS t(band, low, high)), d AS (SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS days FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
    SELECT band, count(*) AS n FROM d JOIN b ON days BETWEEN low AND high GROUP BY 1""")
def period_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderdate", "l_shipdate")
    return planning.period_band(spark, rows, "o_orderdate", "l_shipdate").groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l.doc_id, CASE WHEN l.quality = 1 THEN 'stored' ELSE d.lang END AS lang, d.source FROM documents d JOIN labels l ON l.doc_id = d.doc_id""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    fresh = read(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(labels.select("doc_id"), "doc_id")
    stored = labels.select("doc_id", F.when(F.col("quality") == 1, "stored").otherwise("").alias("lang"))
    return planning.upsert(fresh, stored, ["doc_id"], ["lang"])


# -- guarded SQL over the star schema ------------------------------------------------------------

_STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
MARKETING = {
    "top_brands_interaction": "SELECT p_brand, CAST(sum(l_quantity) AS DOUBLE) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand ORDER BY revenue DESC, p_brand LIMIT 10",
    "engagement_rate": "SELECT s_suppkey, round(sum(l_quantity) / NULLIF(max(s_acctbal), 0), 6) AS rate FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey",
    "campaign_roi": "SELECT o_orderpriority, round(sum(l_extendedprice * (1 - l_discount) - l_extendedprice * 0.5) / NULLIF(sum(l_extendedprice * 0.5), 0), 6) AS roi, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderpriority",
    "nation_reach": "SELECT n_name, r_name, count(c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, r_name",
}


def _guarded(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sqlguard.run(spark, MARKETING[name], {t: read(spark, sf_dir, t) for t in _STAR})

    run.__name__ = name
    return run


for _name, _sql in MARKETING.items():
    query(_sql)(_guarded(_name))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def last_days_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE CAST(ts AS DATE) >= date_sub((SELECT max(CAST(ts AS DATE)) FROM events), 7) GROUP BY event_type"
    return sqlguard.run(spark, sql, {t: read(spark, sf_dir, t) for t in _STAR})


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) FROM events) - INTERVAL 30 DAY GROUP BY 1")
def last30_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE CAST(ts AS DATE) >= date_sub((SELECT max(CAST(ts AS DATE)) FROM events), 30) GROUP BY event_type"
    return sqlguard.run(spark, sql, {t: read(spark, sf_dir, t) for t in _STAR})


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_events.windowed(read(spark, sf_dir, "events"))


# -- rules -------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
    d AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'rag' WHEN 'assistant' THEN 'clarify' ELSE 'unknown' END AS route, turn % 2 = 0 AS flag, CASE WHEN turn % 3 = 0 THEN '' ELSE 'r' END AS reason, CASE WHEN role = 'assistant' THEN text END AS question, CASE WHEN role = 'user' THEN text END AS q FROM c)
    SELECT conv_id, turn, CASE WHEN route = 'unknown' THEN 'route_unknown' WHEN flag <> (route = 'clarify') THEN 'flag_mismatch' WHEN reason = '' THEN 'reason_missing' WHEN route = 'clarify' AND trim(question) = '' THEN 'clarification_question_missing' WHEN route = 'rag' AND trim(q) = '' THEN 'retrieval_query_missing' END AS violation FROM d""")
def route_rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions made from messages: by role a route, by turn a flag and a reason."""
    text = F.coalesce("text", F.lit(""))
    none = F.lit(None).cast("string")
    rows = read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "user", "rag").when(F.col("role") == "assistant", "clarify").otherwise("unknown").alias("route"), F.lit("answer").alias("action"), (F.col("turn") % 2 == 0).alias("needs_clarification"),
        F.when(F.col("role") == "assistant", text).alias("clarification_question"), F.when(F.col("role") == "user", text).alias("retrieval_query"), none.alias("selected_skill"), F.array().cast("array<string>").alias("keywords"), none.alias("brief_path"), F.when(F.col("turn") % 3 == 0, "").otherwise("r").alias("reason"),
    )
    return rows.select("conv_id", "turn", rules.route_violation().alias("violation"))


@query(f"""WITH {bm25_sql()}, h AS (SELECT s.query_id, s.rank, d.source, d.lang FROM sparse s JOIN documents d ON d.doc_id = s.doc_id WHERE rank <= 5), f AS (SELECT query_id, source, lang, min(rank) AS rank FROM h GROUP BY 1, 2, 3)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, source, lang) AS citation_no, source, lang AS section FROM f""")
def citations_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("section"), F.lit("").alias("chunk_index"))
    found = rules.citations(_sparse(spark, sf_dir, 5).select("query_id", "doc_id", "rank").join(docs, "doc_id"))
    return longs(found.select("query_id", "citation_no", "source", "section"), "citation_no")
