"""Demo prompts by language, read from a TypeScript file of constants."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

_TABLE = re.compile(r"Record<string, string\[\]>\s*=\s*\{(.*?)\n\};", re.S)
_LANGUAGE = re.compile(r"([a-z]{2}): \[(.*?)\n  \],?", re.S)
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"')


def parse_prompts(source: str) -> list[tuple[str, int, str]]:
    """(language, number from 0, prompt) of the first table of prompts in a source text."""
    table = _TABLE.search(source)
    if not table:
        raise ValueError("no table of prompts in this file")
    return [(lang, n, json.loads(s)) for lang, block in _LANGUAGE.findall(table[1]) for n, s in enumerate(_STRING.findall(block))]


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """The prompts of a file as a table (lang, nth, text)."""
    source = spark.read.text(path, wholetext=True).first()[0]
    return spark.createDataFrame(parse_prompts(source), "lang string, nth int, text string")
