"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, secret scan, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame;
all but the last return the columns of ``documents``, with n_chars following the text.

Null texts have no words and go in the first stage; a null text that reaches a later one stays null there and packs as its
end id.  Null ids stay, each row by itself; rows that share an id are told apart by their texts, equal rows stay or go together.  Null hosts are a host of
their own.  Of a group of near-duplicates the smallest id stays, and of equal ids the first text.  Texts of any length are worked
on whole.  Extra columns go after the first stage, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import decontaminate, near_dup, packing, quality_rules, secrets
from corpusflow.llm.shared import checkpoint_dir, remove, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _as_documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(quality_rules.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.dedup(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(secrets.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet in the shared folder and read again."""
    where = os.path.join(checkpoint_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    before = None
    for i, (name, stage) in enumerate(STAGES):
        out = f"{where}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            remove(spark, before)
        before = out
    return docs
