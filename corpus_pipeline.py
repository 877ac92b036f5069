"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, SentencePiece.

Every stage takes rows with null or repeated ids, null, empty and very long texts, and columns of any
name; an empty table goes through as one. What each makes of these is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelspark.llm.mixing import mix_documents
from reelspark.llm.pieces import tokens
from reelspark.llm.pii import redact
from reelspark.llm.quality_rules import drop_rejected
from reelspark.llm.simhash import drop_near_copies


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the quality policy rejects; a null or empty text has too few words and goes,
    repeated rows are judged one by one."""
    return drop_rejected(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles have a Jaccard likeness of 0.8 or more: that with
    the smallest id, a null one last. Candidates are linked by SimHash fingerprints through the popcount embedding,
    and by MinHash keys where copies differ in more bits; both are verified. Rows that share an id stay apart by their texts; of rows alike in both
    one stays; null and empty texts are alike."""
    return drop_near_copies(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data replaced by its kind; a null text stays null, and no row goes."""
    return redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix of sources takes of docs, repeats included; texts without words go, a null
    source is one of its own, and rows without id or with one that repeats are taken each by itself."""
    return mix_documents(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with the outcome of decoding them again; a null or empty text has none."""
    return tokens(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", pieces_stage),
]
#: SQL has neither the hash of the fingerprints nor the tagger; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
