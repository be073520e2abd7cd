"""A corpus prepared for training: five stages, each an operator of undulate.llm over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from undulate.llm.common import stored, table
from undulate.llm.op2_language_filters import in_known_language
from undulate.llm.op3_blob_ledger import redacted
from undulate.llm.op6_source_mix import mixed_documents
from undulate.llm.op7_simhash_planes import one_of_each
from undulate.llm.op10_packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and those below the floor of the language that they are taken for, go; see `in_known_language`."""
    return in_known_language(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that of the smallest doc_id; see `one_of_each`."""
    return one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blanked out; every row stays. Null texts stay null."""
    return redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated and cut until their sources have their target words; rows without words go. See `mixed_documents`."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in training sequences; a null text is the end id alone."""
    return pack(docs)


STAGES = [("language_id", language_id), ("simhash_near_dedup", simhash_near_dedup), ("secret_scans", secret_scans), ("source_mix", source_mix), ("packing", packing)]

#: SQL can't express the tokenizer, the filters or the packing; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
