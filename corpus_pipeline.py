"""A corpus pipeline of five operators (language ID, n-gram join, decontamination, PII, packing): each stage works on what its predecessor kept."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import decontaminate, lang_id, ngram_join, packing, pii
from weftgraph.llm.common import owned, release, table, written


# What holds for every stage: all rows that stay keep all columns, whatever their names; a null id is
# an id like others; repeated rows are treated alike (near_copies keeps the first of them); an empty table
# gives an empty one.


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those of null or empty text, without letters, or of no clear language, go."""
    return lang_id.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each group linked by word 5-grams at 0.8 or more; each null text stays."""
    return ngram_join.one_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs: all of them if the benchmark is empty, and those of null text."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts masked; null texts stay null."""
    return pii.mask(docs, chars_col="n_chars" if "n_chars" in docs.columns else None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of 4096 tokens; null texts count as empty."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def _stage(work):
    """A stage that first deletes the working tables of the stages before it: their results have been written by now."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, "pipeline")
        with owned("pipeline"):
            return work(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language", _stage(language)),
    ("near_copies", _stage(near_copies)),
    ("decontamination", _stage(clean_of_benchmark)),
    ("pii", _stage(without_personal_data)),
    ("packing", _stage(packed)),
]

#: SQL cannot express the learned stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on ``documents``, each result written before the next stage reads it.

    A stage's result is deleted when the next one's has been written; the last written one,
    which the returned frame reads, stays until ``release(spark, "pipeline pii")``.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        with owned(f"pipeline {name}"):
            docs = written(found, name)
        if before:
            release(spark, f"pipeline {before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
