"""The corpus pipeline: stages that each apply one operator of pagetrail.llm to what the one before kept.

All stages take empty tables (no rows come out), texts of any length, null keys and extra columns of any name; all but the last return
the rows they keep with all columns as they came.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagetrail.llm import codec, decontaminate, exact, jaccard, langid
from pagetrail.llm.common import TIKTOKEN, cut_lineage, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; texts without one go (all, if nothing was taught), other languages than the taught ones stay.

    Null and empty texts have no letter and go; repeated rows stay.
    """
    return langid.accepted(docs, langid.train(docs, langid.learned_part()))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each text, the one with the largest doc_id.

    A null text counts as an empty one; of repeated rows one stays.
    """
    return exact.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each group of near copies, the one with the smallest doc_id.

    Texts that are null or without words are near nothing and stay.
    """
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs.

    Null and empty texts hold none and stay; null and empty items occur nowhere.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the documents that are left, counted and digested, and read back; one row per row, a null text has no ids."""
    return codec.digests(docs, public_tokenizers.path(TIKTOKEN), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Language identification and decontamination go beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as a table and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
