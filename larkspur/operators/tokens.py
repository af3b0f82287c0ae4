"""Tokens for entities: exact values by aggregation and numbering, persons by fuzzy matching in order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.names import normalize_name, similarity
from larkspur.functions.shared import join_null_safe, store
from larkspur.sources.profiles import SCOPES

REGISTRY = ["tenant_id", "scope", "entity_type"]


def scope_key(scope: str, case_id: str = "case_id", thread_id: str = "thread_id") -> Column:
    """The part of the corpus in which equal values share a token."""
    if scope == "thread":
        return F.concat(F.lit("thread:"), F.col(thread_id))
    if scope == "case":
        return F.concat(F.lit("case:"), F.col(case_id))
    if scope == "tenant":
        return F.lit("tenant:*")
    raise ValueError(f"unknown token scope {scope!r}; it is one of {', '.join(SCOPES)}")


def canonical(value: str = "text") -> Column:
    """The form under which a value is known: lower case, without white space around it."""
    return F.regexp_replace(F.lower(F.col(value)), r"(?U)^\s+|\s+$", "")


def token_of(entity_type: str = "entity_type", ordinal: str = "ordinal") -> Column:
    """[TYPE_NNN], with more digits where needed."""
    return F.format_string("[%s_%03d]", F.col(entity_type), F.col(ordinal))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """Number rows from 1 within keys. One key may hold most rows: it is cut into ranges that are numbered apart.

    The order columns must tell rows of a key apart. A range's numbers start behind the counts of the ranges before.
    The ranges are stored, since a second run of the shuffle might cut them elsewhere. Only a key that is the first or
    last of a range can be in several: there are two for each range at most, so their counts are broadcast.
    """
    ranged = store(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges").df
    key = F.struct(*keys)
    edges = ranged.groupBy("_range").agg(F.array(F.min(key), F.max(key)).alias("_edges")).select(F.explode("_edges").alias("_edge")).select("_edge.*").distinct()
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = join_null_safe(ranged.select(*keys, "_range"), F.broadcast(edges), keys, "left_semi").groupBy(*keys, "_range").count()
    offsets = counts.select(*keys, "_range", F.sum("count").over(before).alias("_before")).where("_before is not null")
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    joined = join_null_safe(ranged, F.broadcast(offsets), [*keys, "_range"], "left")
    return joined.withColumn(name, (F.row_number().over(inside) + F.coalesce("_before", F.lit(0))).cast("long")).drop("_range", "_before")


def resolve_exact(mentions: DataFrame, scope: str = "tenant", registry: DataFrame | None = None) -> DataFrame:
    """Token registry of mentions (tenant_id, case_id, thread_id, msg_seq, start, entity_type, text).

    Values are numbered in the order of their first mention: by message, and in a message from right to left. Given an
    earlier registry, its tokens stay and new values count on from its highest number.
    """
    named = mentions.withColumn("scope", scope_key(scope)).withColumn("canonical", canonical())
    first = named.groupBy(*REGISTRY, "canonical").agg(F.min(F.struct(F.col("msg_seq"), (-F.col("start")).alias("back"))).alias("first"))
    if registry is not None:
        first = join_null_safe(first, registry.select(*REGISTRY, "canonical"), [*REGISTRY, "canonical"], "left_anti")
    flat = first.select(*REGISTRY, "canonical", F.col("first.msg_seq").alias("_seq"), F.col("first.back").alias("_back"))
    made = numbered(flat, REGISTRY, ["_seq", "_back", "canonical"]).drop("_seq", "_back")
    if registry is not None:
        top = registry.groupBy(*REGISTRY).agg(F.max("ordinal").alias("_top"))
        made = join_null_safe(made, top, REGISTRY, "left").withColumn("ordinal", F.col("ordinal") + F.coalesce("_top", F.lit(0))).drop("_top")
    made = made.withColumn("token", token_of()).select(*REGISTRY, "token", "canonical", "ordinal")
    return made if registry is None else registry.select(*made.columns).unionByName(made)


_PERSONS = "tenant_id string, scope string, text string, canonical string, token string, ordinal long"


def resolve_persons(mentions: DataFrame, scope: str = "tenant", threshold: float = 0.75, registry: DataFrame | None = None) -> DataFrame:
    """(tenant_id, scope, text, canonical, token, ordinal) of every distinct PERSON surface form.

    Names match greedily in order of mention: the best known name at the threshold or above, the first of equals. The
    persons of an earlier registry are known from the start, and new ones count on from the highest number. The order
    matters, so a scope is worked through in one place; it sees each surface form once. Prefer the thread or case
    scope where a tenant has very many names.
    """

    def match(forms: pd.DataFrame, earlier: pd.DataFrame) -> pd.DataFrame:
        told = earlier.sort_values("ordinal")
        known: list[str] = told["canonical"].tolist()
        numbers: list[int] = [int(n) for n in told["ordinal"]]
        exact = {k: i for i, k in reversed(list(enumerate(known)))}
        out = []
        for tenant, where, text in forms.sort_values(["seq", "back", "text"])[["tenant_id", "scope", "text"]].itertuples(index=False):
            name = normalize_name(text)
            best = exact.get(name)
            if best is None:
                scores = [similarity(name, k) for k in known]
                best = max(range(len(known)), key=lambda i: (scores[i], -i), default=None)
                if best is None or scores[best] < threshold:
                    best = exact[name] = len(known)
                    known.append(name)
                    numbers.append(max(numbers, default=0) + 1)
            out.append((tenant, where, text, known[best], f"[PERSON_{numbers[best]:03d}]", numbers[best]))
        return pd.DataFrame(out, columns=["tenant_id", "scope", "text", "canonical", "token", "ordinal"])

    named = mentions.where("entity_type = 'PERSON'").withColumn("scope", scope_key(scope))
    first = named.groupBy("tenant_id", "scope", "text").agg(F.min(F.struct(F.col("msg_seq").alias("seq"), (-F.col("start")).alias("back"))).alias("first"))
    # ordered before it goes to Python, where message numbers of any type would have to sort alike
    ranked = numbered(first.select("tenant_id", "scope", "text", "first.seq", "first.back"), ["tenant_id", "scope"], ["seq", "back", "text"], "seq_nth").select("tenant_id", "scope", "text", F.col("seq_nth").alias("seq"), F.lit(0).alias("back"))
    if registry is None:
        known = mentions.sparkSession.createDataFrame([], "tenant_id string, scope string, canonical string, ordinal long")
    else:  # columns of their own, since an earlier registry may come from the same tables
        known = registry.where("entity_type = 'PERSON'").select(*[F.col(c).cast(t).alias(c) for c, t in (("tenant_id", "string"), ("scope", "string"), ("canonical", "string"), ("ordinal", "long"))])
    keys = [F.coalesce("tenant_id", F.lit("")).alias("_t"), F.coalesce("scope", F.lit("")).alias("_s"), F.isnull("tenant_id").alias("_n"), F.isnull("scope").alias("_m")]
    return ranked.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInPandas(match, _PERSONS)
