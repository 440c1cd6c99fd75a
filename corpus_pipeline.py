"""Corpus preparation: stages over ``documents``, each calling one of the operators.

Every stage takes (spark, docs, sf_dir) and returns the documents that stay, with the columns of
``documents``; the last returns the packed pieces.  ``run`` writes each stage's result as Parquet to
the shared folder and reads it again as the next one's input, so a lost executor costs no more than
the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadlens.llm.common import stored
from threadlens.llm.decontam import drop_contaminated
from threadlens.llm.packing import pack_documents
from threadlens.llm.secret_scan import redact_documents
from threadlens.llm.simhash import keep_one_per_component
from threadlens.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go (score 0.7 or more)."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one with the smallest doc_id."""
    return keep_one_per_component(docs, width=3, max_bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or a whole shorter item) go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts (and n_chars follows); every document stays."""
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in sequences of at most 2048 tokens: one row per piece."""
    return pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxicity), ("simhash_dedup", near_dedup), ("decontamination", decontamination),
          ("secret_scans", secret_scans), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
