"""Steps whose work must stay spread out, and right, however large or uneven their tables are."""

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from larkspur.functions import names
from larkspur.functions.shared import store
from larkspur.operators import tokens
from larkspur.plans import analytics, firewall, queries

SF = os.environ.get("LARKSPUR_TEST_DATA", "/root/testdata/sf0.001")


def test_pairs_of_a_large_group_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(analytics, "BLOCK_NAMES", 8)
    monkeypatch.setattr(analytics, "TASK_PAIRS", 100)
    people = [(1, k, f"Élan {k * k}") for k in range(60)] + [(2, 7, "Ann"), (2, 8, "Anna"), (2, 8, "Anton"), (2, 9, None), (None, 1, "x"), (None, 2, "y"), (3, None, "z"), (3, 1, ""), (3, 2, "z")]
    made = analytics.name_distances(spark.createDataFrame(people, "g int, k int, n string"), "g", "k", "n")
    rows = made.withColumn("part", F.spark_partition_id()).collect()
    whole = [(a, b, None if x is None or y is None else names.edit_distance(x, y)) for g, a, x in people for h, b, y in people if g is not None and g == h and None not in (a, b) and a < b]
    assert sorted(((r.a_key, r.b_key, r.distance) for r in rows), key=str) == sorted(whole, key=str)
    per_part = [sum(r.part == p for r in rows) for p in {r.part for r in rows}]
    assert len(per_part) > 8 and max(per_part) < len(rows) / 4


@pytest.fixture
def parts(monkeypatch):
    """How many rows each task gave to a table that was stored, by the table's name."""
    found = {}

    def put(df, name):
        made = store(df.withColumn("_part", F.spark_partition_id()), name)
        found[name] = sorted(r["count"] for r in made.df.groupBy("_part").count().collect())
        return replace(made, df=made.df.drop("_part"))

    monkeypatch.setattr(firewall, "store", put)
    return found


def few_tasks(spark, n):
    """Messages that one task reads."""
    return spark.range(n).coalesce(1).select(F.lit("t").alias("tenant_id"), F.lit("c").alias("case_id"), F.col("id").cast("string").alias("thread_id"), F.col("id").alias("msg_seq"), F.concat(F.lit("mail u"), "id", F.lit("@x.org")).alias("text"))


def test_strings_of_payloads_are_dealt_out(spark, parts):
    rows = few_tasks(spark, 600).select("tenant_id", "case_id", "thread_id", "msg_seq", F.struct("text").alias("payload"))
    done, _ = firewall.Firewall.create(language="en", token_scope="thread").anonymize_payload(rows, "payload")
    assert [r.n for r in done.groupBy("payload.text").agg(F.count("*").alias("n")).collect()] == [600]
    assert all(len(parts[name]) >= 4 and parts[name][-1] < 300 for name in ("payloads", "detected"))


def test_messages_are_dealt_out(spark, parts):
    made = firewall.Firewall.create(language="en", token_scope="thread").anonymize(few_tasks(spark, 600))
    assert made.vault.select("original").distinct().count() == 600
    assert len(parts["detected"]) >= 4 and parts["detected"][-1] < 300


def test_values_are_numbered_once(spark, monkeypatch):
    plans = {}

    def put(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return store(df, name)

    monkeypatch.setattr(firewall, "store", put)
    firewall.Firewall.create(language="en", token_scope="thread").anonymize(few_tasks(spark, 20))
    assert "Window" in plans["registry"] and "Window" not in plans["told"]


def test_numbers_go_on_from_range_to_range(spark):
    """Keys of many ranges, of one and with nulls; only counts of keys at the edges of ranges are looked up."""
    rows = [(k, j, n) for k, j, many in (("a", "x", 3), ("b", None, 700), ("b", "y", 1), (None, None, 400), (None, "x", 2)) for n in range(many)]
    made = tokens.numbered(spark.createDataFrame(rows, "k string, j string, n int").repartition(8), ["k", "j"], ["n"])
    assert sorted(map(tuple, made.collect()), key=str) == sorted(((*r, r[2] + 1) for r in rows), key=str)
    joins = [line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and all("strategy=broadcast" in line for line in joins)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data on this machine")
@pytest.mark.parametrize("name", ["spanish_recognizers", "universal_recognizers", "span_dedupe_counts"])
def test_detection_is_planned_once(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Filter" in line.split("(")[0]] == []
    assert "Generate" in plan and ("Repartition" in plan or name == "span_dedupe_counts")
