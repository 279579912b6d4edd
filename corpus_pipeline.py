"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns
of documents; the last returns ids. Between stages the result is written down.
Each works on all rows its predecessor kept.

Cases: a null text, or one without a letter, has no language and goes first; of
repeated rows, copies and near copies one row stays (the least id, null ids last);
a text of which nothing is left goes; a null lang is filled in; very long texts are
whole everywhere; other columns, whatever their names, are carried to the last
stage; empty tables give an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import bpe, ppm
from lexmill.llm.common import cut, table
from lexmill.llm.decontaminate import remove_contaminated
from lexmill.llm.neardup import keep_first
from lexmill.llm.substrings import drop_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a learned language codes well, lang filled in where it is null.

    Rejected are documents without text or letters, and those that even their best language
    codes in 12 bits a byte or more (text drawn at random, other alphabets).
    """
    return ppm.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates."""
    return keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier in the corpus."""
    return drop_repeats(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which neither two benchmark items nor 13 words in a row of one (all words of one of 8 to 12) occur."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and hashes of ids and decoded text."""
    return bpe.tokens(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("contamination", contamination), ("token_ids", token_ids)]

#: No SQL expresses training, signatures or tokenization; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
