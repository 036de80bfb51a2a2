"""Corpus pipeline: toxicity, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. Every stage but
the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyguard.llm.common import Scratch, table
from tallyguard.llm.jaccard import keep_first
from tallyguard.llm.mixing import apply_mix
from tallyguard.llm.packing import pack
from tallyguard.llm.pii import redact_pii
from tallyguard.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_first(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return redact_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: documents are repeated, cut or left out."""
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into sequences."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("jaccard", jaccard), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: Learned weights and token ids are beyond SQL; tests hold the stages against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each but the last is written and read again.

    A stage's table is removed when the next one's is written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        own = Scratch(spark, f"pipeline-{name}")
        docs = own(stage(spark, docs, sf_dir), name)
        if before:
            before.remove()
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
