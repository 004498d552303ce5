"""The corpus pipeline: each stage is one operator, written as Parquet and read again by the next.

Quality filter, SimHash dedup (one document of a group stays), benchmark decontamination, secret masking
and source mixing, in that order.  Every stage judges all that the one before it kept; all but the last
return the columns of documents, the last adds n_copies, copy and order_key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mirrorsift.llm import decontam, mixing, quality, secrets, simhash
from mirrorsift.runtime import stage, unstage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier, trained on these documents' labels, predicts good."""
    return quality.keep(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group."""
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, verbatim or re-parameterised."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the values of live secrets masked in their texts."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources reach the square roots of their sizes, shuffled."""
    return mixing.poisson_mix(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("secret scan", mask_secrets),
    ("source mixing", mix_sources),
]

#: The classifier and the fingerprints are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        before, docs = docs, stage(step(spark, docs, sf_dir), name.lower().replace(" ", "-"))
        unstage(before)  # its rows are written anew
    return docs
