"""A corpus pipeline: language, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept. All but the last return the
columns of documents. Rows without an id, and rows that share one, are judged by their texts like all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.functions.shared import scratch
from larkspur.llm.common import read_table, store
from larkspur.llm.decontaminate import drop_contaminated
from larkspur.llm.language_id import keep_identified
from larkspur.llm.packing import pack
from larkspur.llm.simhash_dedup import drop_near_duplicates
from larkspur.llm.suffix_dedup import remove_repeats


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language that was learned stay."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays: the one with the smallest doc_id, rows without one last."""
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 100 that start earlier too are cut out; the documents stay."""
    return remove_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item stay."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return pack(docs)


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("best_fit_packing", packed),
]

#: A network, SimHash, byte-level suffixes, alignments and packing are beyond SQL: tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder, each written as Parquet and read again by the next."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch() as made:  # what the stage has put aside goes once its result is written
            after = store(stage(spark, docs, sf_dir), name)
            made.remove(after)
        if before:
            before.drop()
        docs, before = after.df, after
    return STAGES[-1][1](spark, docs, sf_dir)
