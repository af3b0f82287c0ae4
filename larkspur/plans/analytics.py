"""Reports over detected entities, tokens and profiles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.spans import pattern_spans, prefilter_sql, quoted, spans_of_sql
from larkspur.sources.catalog import Catalog, Pattern
from larkspur.sources.profiles import Profile

#: What an audit counts as structured personal data.
AUDITED = [r"[\w.+-]+@[\w-]+\.[\w.-]+", r"\+?\d[\d\s().-]{7,}\d", r"\b[A-Z0-9]{8,}\b"]


_BUILT_IN = set(Catalog.default().all())


def possible_sql(pattern: Pattern, text: str = "text") -> str:
    """A cheap SQL test that every text with a match passes: a mark that the expression can't do without, else the prefilter."""
    marks = [chr(value) for kind, value in re._parser.parse(pattern.regex) if str(kind) == "LITERAL" and not chr(value).isalnum()]
    if marks:
        return " and ".join(f"contains({text}, {quoted(m)})" for m in dict.fromkeys(marks))
    return prefilter_sql(text) if pattern in _BUILT_IN else f"{text} is not null"


def pattern_matches(docs: DataFrame, pattern: Pattern, key: str = "doc_id", *more: str) -> DataFrame:
    """A row for each match of a pattern: key, start, end, text, confidence."""
    found = F.expr(spans_of_sql(lambda seen, odd: pattern_spans(pattern, 0, seen=seen, odd=odd)))
    return docs.where(possible_sql(pattern)).select(key, *more, F.explode(found).alias("s")).select(key, *more, "s.start", "s.end", "s.text", "s.confidence")


def type_counts(docs: DataFrame, patterns: list[Pattern], *by: str) -> DataFrame:
    """Matches by some columns and entity type, without offsets."""
    counts = F.array(*[F.struct(F.lit(p.entity_type).alias("entity_type"), F.size(F.expr(f"regexp_extract_all(text, {quoted(p.java)}, 0)")).alias("n")) for p in patterns])
    able = docs.where(prefilter_sql("text") if _BUILT_IN.issuperset(patterns) else "text is not null")
    rows = able.select(*by, F.explode(counts).alias("c")).where("c.n > 0")
    return rows.groupBy(*by, F.col("c.entity_type").alias("entity_type")).agg(F.sum("c.n").cast("long").alias("n_matches"))


def overlapping(spans: DataFrame, others: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs of spans of one text that share a character."""
    a, b = spans.alias("a"), others.alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    return a.join(b, on).select(F.col(f"a.{key}").alias(key), F.col("a.start").alias("a_start"), F.col("a.end").alias("a_end"), F.col("b.start").alias("b_start"), F.col("b.end").alias("b_end"))


#: Names that are compared with as many others under one key, and pairs that a task has to do with.
BLOCK_NAMES = 512
TASK_PAIRS = 4_000_000
#: Characters up to which a beginning that all names of a group share is looked for.
_SHARED = 256


def name_distances(rows: DataFrame, group: str, key: str, name: str) -> DataFrame:
    """All pairs of a group's rows, the smaller key first: a_key, b_key and the distance of their names.

    There are as many rows as pairs, so the work is quadratic in a group. It is dealt out by pairs of blocks of names,
    however large a group is. What all names of a group begin with doesn't count in a distance and is left out of it.
    """
    own = rows.select(F.col(group).alias("_g"), F.col(key).alias("_k"), F.col(name).alias("_n")).where("_g is not null and _k is not null")
    length = f"least(length(lo), length(hi), {_SHARED})"
    same = f"if({length} > 0, size(filter(sequence(1, {length}), i -> left(lo, i) = left(hi, i))), 0)"  # all others lie between lo and hi
    groups = own.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.min("_n").alias("lo"), F.max("_n").alias("hi"))
    groups = groups.select(F.col("_g").alias("_h"), "n", F.expr(f"coalesce({same}, 0)").alias("same"), F.expr(f"cast(ceil(n / {BLOCK_NAMES}) as int)").alias("blocks"))
    pairs = groups.agg(F.sum(F.expr("n * (n - 1D) / 2"))).first()[0] or 0
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -int(-pairs // TASK_PAIRS))
    told = own.join(groups, F.col("_g") == F.col("_h")).select("_g", "_k", F.expr("substring(_n, same + 1)").alias("_n"), "blocks", F.expr("cast(pmod(xxhash64(_k), blocks) as int)").alias("block"))
    sides = {"a": ("block", "x", "sequence(block, blocks - 1)"), "b": ("x", "block", "sequence(0, block)")}
    a, b = [
        told.withColumn("x", F.explode(F.expr(others))).select(*[F.col(c).alias(f"{side}_{n}") for c, n in (("_g", "g"), (first, "i"), (second, "j"), ("_k", "k"), ("_n", "n"))]).repartition(parts, f"{side}_g", f"{side}_i", f"{side}_j")
        for side, (first, second, others) in sides.items()
    ]
    met = a.join(b.hint("merge"), F.expr("a_g = b_g and a_i = b_i and a_j = b_j and if(a_i = a_j, a_k < b_k, a_k <> b_k)"))
    return met.select(F.least("a_k", "b_k").alias("a_key"), F.greatest("a_k", "b_k").alias("b_key"), F.levenshtein("a_n", "b_n").cast("long").alias("distance"))


def dispositions(spark: SparkSession, profiles: list[Profile]) -> DataFrame:
    rows = [r for p in profiles for r in p.rows()]
    return spark.createDataFrame(rows, "profile string, entity_type string, action string, confidence_threshold double, parameters map<string,string>")


def patterns_table(spark: SparkSession, catalog: Catalog) -> DataFrame:
    rows = [(i, p.entity_type, p.locale, p.regex, p.ignore_case, p.confidence, list(p.context_words), p.description) for i, p in enumerate(catalog.all())]
    return spark.createDataFrame(rows, "pattern_ord int, entity_type string, locale string, regex string, ignore_case boolean, confidence double, context_words array<string>, description string")


def continuity(mentions: DataFrame, thread: str = "conv_id", turn: str = "turn", token: str = "token") -> DataFrame:
    """For each token of a thread the turns in which it occurs, and whether it is in more than one."""
    turns = mentions.groupBy(thread, token).agg(F.array_sort(F.collect_set(turn)).alias("turns"))
    return turns.withColumn("n_turns", F.size("turns").cast("long")).withColumn("continued", F.size("turns") > 1)


def audit(rows: DataFrame, text: str = "text", sanitized: str = "sanitized_text") -> DataFrame:
    """By language: texts, those with structured personal data, and those of which none of it is left.

    A find inside a longer find doesn't count of its own.
    """
    finds = F.array_distinct(F.concat(*[F.regexp_extract_all(F.col(text), F.lit(f"(?U)({rx})"), 1) for rx in AUDITED]))
    longest = F.filter(finds, lambda x: ~F.exists(finds, lambda y: (y != x) & F.contains(y, x)))
    told = rows.withColumn("_finds", longest).withColumn("_left", F.filter("_finds", lambda x: F.contains(F.col(sanitized), x)))
    return told.groupBy("lang").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(F.size("_finds") > 0).alias("n_with_data"), F.count_if((F.size("_finds") > 0) & (F.size("_left") == 0)).alias("n_clean"))
