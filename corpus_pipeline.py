"""A corpus pipeline: toxicity, near duplicates, benchmark leaks, source mix. Each stage works on what the one before kept.

Defined results: without documents no rows; without labels of both kinds no document is toxic; without a benchmark none
leaks; a null or empty text is near to nothing and holds no leak, and the mix takes no words of it; of equal texts the one
with the smallest id stays; null ids, sources and other columns are kept as they are, whatever the columns' names, but for
mix_words, which the mix gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellweave.llm import decontaminate, jaccard, mixing, toxicity
from cellweave.llm.scratch import drop, keep
from cellweave.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't find toxic."""
    ship_package(spark)
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 75 % of their five-word shingles."""
    ship_package(spark)
    return jaccard.one_per_component(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    ship_package(spark)
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, and how many (repeats counted)."""
    ship_package(spark)
    return mixing.mixed_documents(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, keep(stage(spark, docs, sf_dir), name)
        drop(before)
    return docs


#: A trained classifier decides the first stage, so SQL can't give these rows; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None
