"""Originals back in the place of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.shared import join_null_safe, unused
from larkspur.operators.vault import CASE


def rehydrate_sql(text: str = "text", mapping: str = "mapping") -> str:
    """SQL for a text with its tokens replaced one after another, longer tokens first."""
    longest_first = f"array_sort(map_entries({mapping}), (a, b) -> case when length(a.key) <> length(b.key) then length(b.key) - length(a.key) when a.key < b.key then -1 when a.key > b.key then 1 else 0 end)"
    return f"if({mapping} is null, {text}, aggregate({longest_first}, {text}, (t, e) -> replace(t, e.key, e.value)))"


def restored(text: Column, mapping: Column) -> Column:
    """rehydrate_sql for columns; the mapping isn't null."""
    longest = F.array_sort(F.map_entries(mapping), lambda a, b: F.when(F.length(a["key"]) != F.length(b["key"]), F.length(b["key"]) - F.length(a["key"])).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.aggregate(longest, text, lambda t, e: F.replace(t, e["key"], e["value"]))


def rehydrate(messages: DataFrame, mappings: DataFrame, text: str = "text", out: str = "final_text") -> DataFrame:
    """Rehydrate messages by the mappings of their threads; messages of threads without one stay as they are."""
    name = unused("_mapping", messages.columns)
    joined = join_null_safe(messages, mappings.select(*CASE, F.col("mapping").alias(name)), CASE, "left")
    return joined.withColumn(out, F.expr(rehydrate_sql(text, name))).drop(name)


def rehydrate_chunks(chunks: DataFrame, mappings: DataFrame) -> DataFrame:
    """The batch form of a stream: the chunks of each thread in order as one text, rehydrated."""
    whole = chunks.groupBy(*CASE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_seq", "chunk"))), lambda c: c["chunk"]), "").alias("text"))
    return rehydrate(whole, mappings).select(*CASE, "final_text")
