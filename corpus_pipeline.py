"""The corpus pipeline: toxic documents, exact and near copies and leaked benchmark items go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the
columns of documents.  ``run`` writes each stage's result to the shared folder and rereads it.

Defined cases are those of the operators: null texts are empty (kept once by the exact dedup), repeated rows are copies, an
empty table stays empty, extra columns (of any names) are carried through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemospark.llm import decontam, exact_dedup, near_dedup, packing, toxicity
from mnemospark.llm.common import persist, small_batches


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return exact_dedup.drop_copies(docs)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dedup.drop_near_duplicates(docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("exact_dedup", stage_exact_dedup),
    ("near_dedup", stage_near_dedup),
    ("decontamination", stage_decontamination),
    ("packing", stage_packing),
]

#: Trained scores and random branching aren't SQL; tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = persist(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
