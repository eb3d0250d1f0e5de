"""The queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm import exact_dedup, fingerprint, html_extract, packing, pii, quality, secret_scan, sentence_pieces, simhash_neardup, warc
from rillstone.llm.common import table


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.report(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = html_extract.extracted(pages, html_extract.train(pages))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(table(spark, sf_dir, "documents"), keep="max")


def op6_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_neardup.classes(table(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~quality.held_out()))
    found = quality.scored(docs, model)
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_pieces.round_trip(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "ids_crc32", "decoded_sha256", "ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprint": op1_fingerprint,
    "op2_html_extract": op2_html_extract,
    "op3_packing": op3_packing,
    "op4_warc": op4_warc,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_simhash_neardup": op6_simhash_neardup,
    "op7_quality": op7_quality,
    "op8_secret_scan": op8_secret_scan,
    "op9_pii": op9_pii,
    "op10_sentence_pieces": op10_sentence_pieces,
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS digest FROM p),
        g AS (SELECT digest, max(page_id) AS rep FROM d WHERE n >= 1000 GROUP BY digest)
        SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
               CASE WHEN g.rep IS NOT NULL AND g.rep <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN g.rep IS NOT NULL AND g.rep <> d.page_id THEN g.rep END AS refers_to
        FROM d LEFT JOIN g ON d.digest = g.digest AND d.n >= 1000
    """,
    "op5_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.text) AS text_sha256
        FROM t JOIN g ON t.text = g.text
    """,
}
