"""Languages of messages: detectors, and the language of a thread as it goes on."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.shared import unused
from larkspur.sources.languages import CACHE_SECONDS, FALLBACK, SWITCH_CONFIDENCE


@dataclass
class Detector:
    """load() runs once in a worker; guess(model, text) gives (language, confidence). Short texts are the fallback's."""

    guess: Callable
    load: Callable = field(default=lambda: None)
    least_chars: int = 10
    fallback: str = FALLBACK

    def add_language(self, rows: DataFrame, text: str = "text", out: str = "detected", sure: str = "confidence") -> DataFrame:
        """The rows with a column for the language found in their text, and one for how sure that is."""
        load, guess, least, other = self.load, self.guess, self.least_chars, self.fallback

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for batch in batches:
                told = [guess(model, t) if t is not None and len(t.strip()) >= least else (other, 0.0) for t in batch[text]]
                yield batch.assign(**{out: [a for a, _ in told], sure: [float(b) for _, b in told]})

        kept = rows.drop(out, sure)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
        return kept.mapInPandas(run, f"{schema}, `{out}` string, `{sure}` double")


def _langdetect(module, text: str) -> tuple[str, float]:
    best = module.detect_langs(text)[0]
    return best.lang, best.prob


def _fasttext(model, text: str) -> tuple[str, float]:
    labels, scores = model.predict(text.replace("\n", " "), k=1)
    return labels[0].removeprefix("__label__"), float(scores[0])


def create_detector(backend: str = "langdetect", model_path: str | None = None, fallback: str = FALLBACK) -> Detector:
    """A detector by name. Its library must be there, and fasttext's model in a file that all workers have."""
    if backend not in ("langdetect", "fasttext"):
        raise ValueError(f"unknown detector {backend!r}; there are langdetect, fasttext")
    importlib.import_module(backend)
    if backend == "langdetect":
        return Detector(_langdetect, lambda: importlib.import_module("langdetect"), 10, fallback)
    if not model_path:
        raise ValueError("fasttext needs model_path, the file of its model")
    return Detector(_fasttext, lambda: importlib.import_module("fasttext").load_model(model_path), 5, fallback)


def resolve_languages(rows: DataFrame, thread: list[str], order: list[str], at: str | None = None, ttl: int = CACHE_SECONDS) -> DataFrame:
    """The rows with a column language, given lang (set by hand, or null), detected and confidence.

    A language set by hand holds for its message alone. Otherwise a thread keeps the language of its last message that
    set it: the first one, one that agrees, or one at least SWITCH_CONFIDENCE sure. at: a column with the time in
    seconds; a language that was set more than ttl seconds before has expired. Threads are worked through in order in
    one pass over sorted partitions, which holds one thread's language at a time, however long the thread.
    """
    kept = rows.drop("language")
    clock = unused("_at", kept.columns)
    # a row number in the sort order would cost a shuffle more: the fold sees rows as they come
    sorted_rows = kept.withColumn(clock, (F.col(at) if at else F.lit(0)).cast("double")).repartition(*thread).sortWithinPartitions(*thread, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, cached, since = None, None, 0.0
        for batch in batches:
            told = []
            for key, manual, found, sure, when in zip(zip(*(batch[c].where(batch[c].notna(), None) for c in thread), strict=True), batch["lang"], batch["detected"], batch["confidence"], batch[clock], strict=True):
                if key != now:
                    now, cached = key, None
                if manual is not None and manual == manual:
                    told.append(manual)
                    continue
                if cached is not None and when - since > ttl:
                    cached = None
                if found is not None and found == found and (cached is None or found == cached or sure >= SWITCH_CONFIDENCE):
                    cached, since = found, when
                told.append(cached or FALLBACK)
            yield batch.drop(columns=[clock]).assign(language=told)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return sorted_rows.mapInPandas(run, f"{schema}, language string")


def purge_languages(cache: DataFrame, now: int, ttl: int = CACHE_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(rows of a table of threads' languages with set_at that are still good, one row with the count of the others)."""
    stale = F.lit(now) - F.col("set_at") > ttl
    return cache.where(~stale), cache.agg(F.count_if(stale).alias("purged"))
