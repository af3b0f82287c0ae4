"""One query for each corpus operator, with production parameters, over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_scan
from .common import read_table, shared_dir, store
from .decontaminate import contamination
from .embedding_dedup import embedding_groups
from .html_extract import extract_main_text
from .language_id import identify
from .lm_score import score_texts
from .packing import pack
from .simhash_dedup import simhash_groups
from .suffix_dedup import dedup_substrings
from .token_counts import TokenRollup, counted, deletes, inserts, production_tokenizers, revisions


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))


def _rollup(spark: SparkSession, sf_dir: str, tokenizers: dict[str, str | None]) -> DataFrame:
    """All documents arrive, in a batch that is sent twice and counts once. Then those without a language are revised
    to `und`, and those without a text are deleted."""
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/larkspur/rollup-{uuid.uuid4().hex}")
    rows = store(counted(read_table(spark, sf_dir, "documents"), tokenizers), "counted")
    old = rows.df.where("lang is null")
    new = old.withColumn("lang", F.lit("und"))
    for _ in range(2):
        rollup.commit("arrival-1", inserts(rows.df))
    rollup.commit("revision-1", revisions(old, new))
    rollup.commit("deletion-1", deletes(rows.df.where("n_chars = 0").withColumn("lang", F.coalesce("lang", F.lit("und")))))
    rows.drop()
    rollup.compact()
    return rollup.totals()


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, production_tokenizers())


def token_rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for words between ASCII white space alone, which SQL can count."""
    return _rollup(spark, sf_dir, {"whitespace-1": None})


_ROLLUP_SQL = """select source, coalesce(lang, 'und') as lang, 'whitespace-1' as tokenizer, count(*) as n_docs,
cast(sum(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) as bigint) as n_tokens, cast(sum(length(text)) as bigint) as n_chars
from documents where text is not null and text <> '' group by 1, 2"""


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(read_table(spark, sf_dir, "embeddings"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_language_id": op2_language_id,
    "op3_license_scan": op3_license_scan,
    "op4_token_counts": op4_token_counts,
    "op5_html_extraction": op5_html_extraction,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_simhash_dedup": op10_simhash_dedup,
    "token_rollup_words": token_rollup_words,
}

ORACLES: dict[str, str] = {
    "op3_license_scan": license_scan.oracle(),
    "token_rollup_words": _ROLLUP_SQL,
}
