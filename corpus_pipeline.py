"""The corpus pipeline: stages over documents, each written and read again by the next.

All stages take whole texts of any length, an empty table, and columns beside doc_id and text, whatever their names; all but the last return the
columns that they were given."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, jaccard_join, line_rules, packing, pii
from tidemark.llm.common import documents, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the others keep their whole texts. Null and empty texts have no words and go. Rows are judged alone: of
    repeated rows all go or all stay, and a null doc_id makes no difference."""
    return line_rules.passing(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays. A null text equals an empty one. Rows that repeat this doc_id and text all stay; a null doc_id
    loses to any other, and a group of null ones alone keeps all its rows."""
    return exact_dedup.without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays, and with it all rows that repeat this doc_id. Texts without words (null,
    empty) link with nothing and stay, and so do rows with a null doc_id."""
    return jaccard_join.one_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind, and n_chars follows. No row goes: null and empty texts stay as they are, rows with a null or repeated
    doc_id are each redacted, and equal texts alike. Of spans that overlap the first names the kind, and the rest of the other goes with it."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What remains is packed into sequences of 2048 tokens: one row per piece. A null or empty text is a piece of the end token alone; rows that repeat a
    doc_id are packed each for itself, and a null doc_id is carried. Pieces of one length are interchangeable."""
    return packing.packed(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("pii", private), ("packing", pack)]
#: The field of the PII stage and the packing's tokens can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
