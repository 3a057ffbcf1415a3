"""The registered queries of the training-data operators, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import (
    centroids,
    class_lm,
    decontam,
    exact_dedup,
    funnel,
    html_article,
    near_dedup,
    packing,
    pii,
    sharding,
    substring_dedup,
    token_files,
    toxicity,
)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_docs(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.hits(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(_docs(spark, sf_dir), width=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(_docs(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_docs(spark, sf_dir), digest=True)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(_docs(spark, sf_dir))
    back = token_files.read_tokens(spark, manifest)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_crc(packing.pack(_docs(spark, sf_dir)))


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.scores(_docs(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_docs(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.count_funnels(spark.read.parquet(f"{sf_dir}/clicks.parquet"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_html_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_article.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_near_dedup": op3_near_dedup,
    "op4_pii": op4_pii,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_token_files": op6_token_files,
    "op7_packing": op7_packing,
    "op8_class_lm": op8_class_lm,
    "op9_sharding": op9_sharding,
    "op10_toxicity": op10_toxicity,
    "op11_funnel": op11_funnel,
    "op12_centroids": op12_centroids,
    "op13_html_article": op13_html_article,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op2_decontamination": decontam.ORACLE,
    "op3_near_dedup": near_dedup.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op11_funnel": funnel.oracle(),
    "op12_centroids": centroids.oracle(),
}
