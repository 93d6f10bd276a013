"""A training-data pipeline of five stages over ``documents``, one operator each.

Stages, in order: quality rules (rejected documents go), near-duplicate removal (one document of each group stays),
benchmark decontamination (contaminated documents go), redaction of personal data (the text changes, ``n_chars``
with it), SentencePiece encoding (the last stage returns token ids, and whether decoding gives the text back).

Every stage works on all rows that the stage before it kept. `run` writes each stage's rows as Parquet below
spark.checkpoint.dir (a temporary folder on a local master where that is unset) and reads them again, so that no stage computes
another one anew and a lost executor costs no more than a reread.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from throngline.llm import decontam, neardup, pieces, pii, quality
from throngline.llm.text import free, shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood-ratio test. Null texts go, since they have no words."""
    name = free(docs, "quality")
    judged = quality.judge(docs, table(spark, sf_dir, "labels").where("quality = 1"), out=name)
    return judged.where(f"{name}.kept").drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id.

    Null and wordless texts belong to no group and stay; of repeated rows one stays; rows with a null id stay.
    """
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a twentieth or more of their words inside benchmark windows. Null and empty texts stay; an empty benchmark removes nothing."""
    return decontam.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets. A null text stays null, with a null n_chars."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids, their number, and whether they decode to the text. A null text has null ids, no tokens and counts as decoded."""
    return pieces.coded(docs.select("doc_id", "lang", "source", "text")).drop("text")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("sentencepiece", sentencepiece),
]
#: SQL has neither the hash functions nor the trees and lattices of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    folder = f"{folder}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
