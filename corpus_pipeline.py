"""Cleaning a corpus: each stage reads what the one before has kept, whole.

``run`` applies the stages to ``documents``; between two stages the rows go through a
Parquet table in the shared folder, which goes when the next one is written.

Defined results, by what the operators say: rows without letters go with the first stage; a
null id is an id like others; of repeated rows and near copies one row stays; further
columns travel along up to the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.llm import bpe, langid, mixing, pii, simhash
from logloom.llm.common import drop_table, read, scratch, table
from logloom.llm.queries import RANKS, pattern


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language identification rejects: no letters, or like no language it knows.

    Those that have no language get the one that was found.
    """
    fitted = langid.fit(docs.where(~langid.held_out()))
    return langid.accepted(docs, fitted)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component, the one with the smallest id."""
    return simhash.first_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each span of personal data by its kind."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks for."""
    return mixing.expand(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``source``, number and digests of tokens, and the ``token_ids``."""
    ranks = bpe.load_ranks(spark, RANKS())
    return bpe.encoded(docs, ranks, pattern(), with_ids=True, keep=["source"])


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Character models and SimHash are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(table(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
