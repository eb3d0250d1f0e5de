"""Documents to packed training sequences, in stages that each write what the next one reads.

Every stage but the last returns the columns of documents. A row that a stage rejects is
gone for the stages after it; personal data is replaced in the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm import exact_dedup, packing, pii, quality, simhash_neardup
from rillstone.llm.common import materialise, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels, does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = max(docs.columns, key=len) + "_score"  # longer than any name, so no column's own
    return quality.scored(docs, model, score_col=score).where(F.col(score) >= 0.5).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the smallest id."""
    return exact_dedup.distinct_documents(docs, keep="min")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the smallest id: five-word shingles, similarity 0.8."""
    return simhash_neardup.one_of_each(docs, width=5, similarity=0.8)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("PII", mask_personal_data),
    ("packing", pack),
]

#: SQL has neither the classifier nor the tokenizer; tests compare with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
