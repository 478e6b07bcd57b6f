"""The corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, packing."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from ohlspark.llm.common import delete, passing, shared_folder, table
from ohlspark.llm.op01_decontaminate import decontaminated
from ohlspark.llm.op03_bagminhash import deduplicated
from ohlspark.llm.op07_secrets import redacted
from ohlspark.llm.op08_perplexity import kept_documents
from ohlspark.llm.op09_packing import pack


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("packing", packing),
]

#: SQL can express neither the models nor the tokenizer; tests hold planted cases and each stage's operator against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of documents. Each stage's result is written to the
    folder that the cluster shares (spark.checkpoint.dir) and read again; a local folder only where that is unset. A stage is deleted once the next
    one is written, and the last when the application ends."""
    docs = table(spark, sf_dir, "documents")
    out = passing(spark, f"{shared_folder(spark)}/pipeline-{uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
        if k:
            delete(spark, f"{out}/{k - 1}")
    return docs
