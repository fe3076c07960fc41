"""A corpus pipeline: quality rules, toxicity, near duplicates, secrets, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; run() writes what a stage returns as Parquet and reads it again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import ngram_join, packing, quality, secret_scan, toxicity
from corpusloom.llm.common import stage, table, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail the base rules, or in which boilerplate lines outweigh content, go; null and empty texts fail them."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose nearest labelled examples call them toxic go; a text near no example scores as the prior."""
    return toxicity.keep(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles at a similarity of 0.8 or more, the one of the smallest id stays.

    Goes by id and text; repeated rows stay once, rows of null id and texts without words stay as they are.
    """
    return ngram_join.representatives(docs, n=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to their kind in brackets; no text goes, null texts stay null. n_chars follows the text."""
    return secret_scan.redacted(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every text left lies in the training sequences; null and empty texts have no bin."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_texts),
    ("ngram_join", near_duplicates),
    ("secret_scan", secrets),
    ("best_fit_packing", packed),
]

#: SQL can express neither the trained stages nor the packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
