"""A training corpus from the documents table: five stages, each an operator of storyloom.llm.

Each stage takes (spark, docs, sf_dir); its result is written and read again as the next one's docs.

Nulls, empty and very long texts, ties, repeated rows, empty tables and columns of other names have the results that each
operator's docstring states: a null or empty text has no words, so the first stage drops it; rows that repeat an id and a
text are judged alike by every stage; an empty table stays empty; further columns come along up to the last stage, whose
result is doc_id and what encoding gives.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import decontamination, line_dedup, near_dedup, quality_rules, sentencepiece_codec
from storyloom.llm.common import staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.filter_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of smaller id holds; those of which nothing stays, go."""
    return line_dedup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: shingles of five words, similarity of 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs, width=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids, decoded and round_trip of each document that is left."""
    model = sentencepiece_codec.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece_codec.encode(docs, model)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("SentencePiece", encoded),
]

#: SQL can't express subword encoding; tests/llm/test_pipeline_brute.py holds the stages against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
