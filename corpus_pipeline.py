"""A corpus pipeline of five stages, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and reads it again as the
next one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import bpe, mixing, neardup, pii, toxicity
from sieveline.llm.queries import vocabulary_path
from sieveline.session import scratch, stash, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't reject; it learns from the labelled documents of ``sf_dir``."""
    machine = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, machine)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingles of five words are alike to 0.8 or more."""
    return neardup.keep_one(docs, width=5, threshold=0.8)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the names of their kinds."""
    return pii.without_personal_data(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of each document that the mix takes, once for each time that it takes them."""
    return mixing.mixed_texts(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text."""
    out = bpe.encode(docs.select("doc_id", "source", "lang", "text"), vocabulary_path())
    return out.select("doc_id", "source", "lang", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [("toxicity", clean), ("near_dedup", distinct), ("pii", private), ("mixing", mixed), ("bpe", encoded)]

#: SQL can't express a learned machine or byte-pair merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over ``documents``; what they wrote goes, but for the last one's rows."""
    with scratch(spark) as keep:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES:
            docs = stash(stage(spark, docs, sf_dir), name)
        return keep(docs)
