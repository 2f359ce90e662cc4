"""The corpus pipeline: operators for training text, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from headwater.llm import bpe, decontamination, simhash, suffixes, toxicity
from headwater.session import scratch, work_folder


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one of the smallest doc_id."""
    return simhash.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that the corpus repeats are cut from the texts."""
    return suffixes.without_passages(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, checked by decoding them."""
    return bpe.round_trip(docs)


STAGES = [("toxicity", toxic), ("simhash", near_copies), ("suffix_array", repeats), ("decontamination", leaks), ("byte_bpe", tokens)]

# Fitted scores, XXH64 fingerprints and token merges have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = work_folder(spark, name)
        with scratch(spark):
            found = stage(spark, docs, sf_dir)
            found.write.parquet(kept)
        docs = spark.read.schema(found.schema).parquet(kept)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
