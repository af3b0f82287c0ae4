"""Checks of PERSON spans by parts of speech: a tagger plug-in trims their ends and drops what isn't a name."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.shared import unused
from larkspur.sources.entities import SPANS_SQL

# Parts of speech that no name begins or ends with, that no name begins with, and those of predicates.
EDGES = set("VERB AUX ADV ADP DET CONJ CCONJ SCONJ PART".split())
NOT_FIRST = EDGES | {"INTJ"}
PREDICATES = {"VERB", "AUX"}
INNER_MARKS = {".", "'", "-"}
#: Characters before and behind a span that are tagged with it.
BEFORE, BEHIND = 30, 10


class Word(NamedTuple):
    """A tagged word: its place in the tagged text, its part of speech, and whether the sentence hangs on it."""

    start: int
    end: int
    text: str
    pos: str
    root: bool = False


def _short(text: str) -> bool:
    return text.endswith(".") and text[:-1].isalpha() and len(text) <= 5


def trimmed(words: list[Word]) -> tuple[int, int] | None:
    """The part of a tagged span that is a name, by places in the span; None: leave it as it is."""
    inner = [i for i, w in enumerate(words) if w.pos not in EDGES]
    if not inner:
        return None
    first, last = inner[0], inner[-1]
    proper = [i for i in range(first, last + 1) if words[i].pos == "PROPN"]
    if proper:
        low, last = proper[0], proper[-1]
        if low > first and words[low - 1].pos in ("NOUN", "PROPN") and words[low - 1].text[:1].isupper():
            low -= 1
        if low > first and _short(words[low - 1].text):
            low -= 1
        first = low
        if last + 1 < len(words) and len(words[last].text) <= 2 and words[last + 1].text == ".":
            last += 1
    return words[first].start, words[last].end


def beside_predicate(words: list[Word], start: int, end: int) -> bool:
    """In tagged words around a span: does it begin or end with a verb, or follow one?"""
    inside = [w for w in words if w.start >= start and w.end <= end]
    before = [w for w in words if start - 2 <= w.end <= start]
    if inside and (inside[0].pos in PREDICATES | {"ADV"} or inside[-1].pos in PREDICATES):
        return True
    return bool(before) and before[-1].pos in PREDICATES


def like_a_name(text: str, words: list[Word]) -> bool:
    """Can a tagged text be a name? In doubt it can."""
    if not words or words[0].pos in NOT_FIRST or any(w.root and w.pos in PREDICATES for w in words):
        return False
    if any(w.pos == "PUNCT" and w.text not in INNER_MARKS and not _short(w.text) for w in words):
        return False
    kinds = {w.pos for w in words if w.pos != "PUNCT"}
    if len(words) > 1 and "PROPN" not in kinds and not kinds <= {"NOUN"}:
        return False
    return any(x[0].isupper() for x in text.split()) if text.split() else True


@dataclass
class Tagger:
    """load() runs once in a worker; tag(model, text) gives the words of a text."""

    tag: Callable
    load: Callable = field(default=lambda: None)

    def _change(self, rows: DataFrame, spans: str, change: Callable, text: str) -> DataFrame:
        """The rows with spans changed one by one; rows without a person don't go to Python's tagger."""
        load, tag = self.load, self.tag
        name = unused("_spans", rows.columns)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for batch in batches:
                new = []
                for own, whole in zip(batch[spans], batch[text], strict=True):
                    listed = [dict(s) for s in own] if own is not None else []
                    new.append([s if s["entity_type"] != "PERSON" else t for s in listed if (t := s if s["entity_type"] != "PERSON" else change(lambda x: tag(model, x), whole, s)) is not None])
                yield batch.assign(**{name: new})

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        made = rows.mapInPandas(run, f"{schema}, `{name}` {SPANS_SQL}")
        return made.withColumn(spans, F.col(name)).drop(name)

    def trim(self, rows: DataFrame, spans: str, text: str = "text") -> DataFrame:
        """PERSON spans without function words at their ends."""

        def change(tag: Callable, whole: str, s: dict) -> dict:
            part = trimmed(tag(whole[s["start"] : s["end"]]))
            if part is None or part[0] >= part[1]:
                return s
            a, b = s["start"] + part[0], s["start"] + part[1]
            return s | {"start": a, "end": b, "text": whole[a:b]}

        return self._change(rows, spans, change, text)

    def judge(self, rows: DataFrame, spans: str, text: str = "text") -> DataFrame:
        """PERSON spans without those that can't be names."""

        def change(tag: Callable, whole: str, s: dict) -> dict | None:
            a, b = max(0, s["start"] - BEFORE), min(len(whole), s["end"] + BEHIND)
            if beside_predicate(tag(whole[a:b]), s["start"] - a, s["end"] - a):
                return None
            if len(s["text"].split()) == 1 and len(s["text"]) < 3:
                return None
            return s if like_a_name(s["text"], tag(s["text"])) else None

        return self._change(rows, spans, change, text)
