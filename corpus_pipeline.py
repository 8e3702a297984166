"""A training corpus from raw documents, in stages that are each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur import on_workers
from larkspur.llm import mixing, packing, simhash, suffix_dedup, toxicity
from larkspur.llm.queries import tokenizer
from larkspur.llm.shared import table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. The classifier learns from the labelled rows of its input."""
    on_workers(spark)
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity 0.8."""
    on_workers(spark)
    return simhash.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has too are cut out."""
    on_workers(spark)
    return suffix_dedup.cut(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gets its target share, by Poisson replication; copies of a document keep its doc_id."""
    return mixing.mix(docs).drop("mix_copy", "mix_key")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens."""
    on_workers(spark)
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("toxicity", toxic), ("simhash near-dedup", near_copies), ("suffix-array dedup", repeats), ("mixing", mixed), ("packing", packed)]

#: SQL can express neither the classifier nor the fingerprints nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
