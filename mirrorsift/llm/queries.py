"""The queries opN_<name> and pipeline, as thin layers over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mirrorsift.llm import decontam, licenses, mixing, neargraph, passages, pii, quality, secrets, simhash, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pruned_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neargraph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, sf_dir, "documents"))


def op5_warc_index_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_license_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_doubling_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(table(spark, sf_dir, "documents"))


def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pruned_graph_dedup": op1_pruned_graph_dedup,
    "op2_pii_skip_chain": op2_pii_skip_chain,
    "op3_pu_quality": op3_pu_quality,
    "op4_poisson_mixing": op4_poisson_mixing,
    "op5_warc_index_first": op5_warc_index_first,
    "op6_template_decontamination": op6_template_decontamination,
    "op7_license_patience": op7_license_patience,
    "op8_doubling_substring_dedup": op8_doubling_substring_dedup,
    "op9_secret_ownership": op9_secret_ownership,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}

ORACLES: dict[str, str] = {
    "op1_pruned_graph_dedup": neargraph.ORACLE,
    "op4_poisson_mixing": mixing.ORACLE,
    "op5_warc_index_first": warc.ORACLE,
    "op8_doubling_substring_dedup": passages.ORACLE,
}
