"""detect_entities(text, locale) as a table function of SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from larkspur.functions.spans import CONTEXT_BOOST, CONTEXT_CHARS
from larkspur.sources.catalog import Catalog

SCHEMA = "start int, end int, text string, entity_type string, confidence double, source string"


def register_detect_entities(spark: SparkSession, catalog: Catalog | None = None, name: str = "detect_entities") -> None:
    """Register the raw spans of a text as rows, for use in SQL and lateral joins; overlaps are left in.

    It runs Python's expressions row by row: for whole tables, functions.spans.detect is the fast way.
    """
    own = catalog or Catalog.default()

    class Detect:
        def eval(self, text: str | None, locale: str | None) -> Iterator[tuple]:
            if text:
                low = text.lower()
                found = []
                for nth, p in enumerate(own.for_locale(locale or "US")):
                    for part, a, b in p.match(text):
                        around = low[max(0, a - CONTEXT_CHARS) : b + CONTEXT_CHARS]
                        near = any(w.lower() in around for w in p.context_words)
                        found.append((a, nth, b, part, p.entity_type, min(1.0, p.confidence + CONTEXT_BOOST) if near else p.confidence, f"pattern:{p.locale}"))
                for a, _, *rest in sorted(found, key=lambda x: x[:2]):
                    yield (a, *rest)

    spark.udtf.register(name, udtf(Detect, returnType=SCHEMA))
