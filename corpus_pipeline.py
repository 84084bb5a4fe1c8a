"""The training-data pipeline: stages that each read what their predecessor wrote."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hostgraph.llm import packing, pii, prob_minhash, toxicity
from hostgraph.llm.store import drop_table, write_table
from hostgraph.sources.tables import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a factorization machine, learned from the labels of the documents that are
    not held out, does not call toxic; all columns as they were."""
    return toxicity.reject(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near-duplicates."""
    return prob_minhash.keep_one(docs, prob_minhash.near_duplicates(docs))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets."""
    return pii.redact(docs, pii.find(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of what is left: one row per piece."""
    return packing.digest(packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("pii", mask_private), ("packing", pack)]

ORACLE_SQL = None     # model scores and token ids have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages; each result is written and read again, and the one before it deleted."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            drop_table(spark, before)
        before = path
    return docs
