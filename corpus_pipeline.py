"""A pipeline from raw documents to packed training sequences. Counts as part of textloom.llm.

Stages: toxic documents go; of equal documents the longest stays; of near copies the one with the
smallest id stays; secrets are masked; what is left is packed. Every stage but the last returns the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import best_fit_packing, exact_dedup, secret_scan, simhash, storage, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with null, empty or wordless texts stay unless the classifier's intercept rejects them; null ids and repeated rows are judged like others. Without positives, and from an empty table, nothing goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts equal empty ones. Rows are judged one by one: a null id never wins a tie, of repeated rows one stays, and rows that share an id stay where their texts differ. An empty table gives an empty table."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, Jaccard 0.8. Of texts that links connect, the row with the smallest id stays, a null id last; texts without words equal each other; of repeated rows one stays, and rows that share an id are judged one by one. An empty table gives an empty table."""
    return simhash.without_near_copies(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, in all columns; a null text stays null. n_chars follows the text. An empty table gives an empty table."""
    return secret_scan.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null or empty text is one piece that holds the end id alone; repeated rows and null ids are packed like others. An empty table gives an empty table."""
    packed = best_fit_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL expresses neither the classifier nor the tokeniser; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
