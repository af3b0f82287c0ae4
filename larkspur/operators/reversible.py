"""Operators by entity type whose record lets encrypted spans be restored: replace, redact, hash, mask, encrypt, keep."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.spans import quoted

OPERATORS = ["replace", "redact", "hash", "mask", "encrypt", "keep"]
ITEMS_SQL = "array<struct<start:int,end:int,entity_type:string,operator:string,text:string>>"


def operator_sql(name: str, params: dict[str, Any] | None, text: str, entity_type: str) -> str:
    """SQL for what an operator makes of a text. encrypt: AES in CBC mode under a key of 16, 24 or 32 bytes, in base64."""
    p = params or {}
    if name == "replace":
        return quoted(p["new_value"]) if p.get("new_value") is not None else f"concat('<', {entity_type}, '>')"
    if name == "redact":
        return "''"
    if name == "hash":
        return f"sha2({text}, {512 if p.get('hash_type') == 'sha512' else 256})"
    if name == "mask":
        many, char = int(p.get("chars_to_mask", 12)), p.get("masking_char", "*")
        if p.get("from_end"):
            return f"concat(left({text}, greatest(length({text}) - {many}, 0)), repeat({quoted(char)}, least({many}, length({text}))))"
        return f"concat(repeat({quoted(char)}, least({many}, length({text}))), substring({text}, {many} + 1))"
    if name == "encrypt":
        key = str(p["key"])
        if len(key.encode()) not in (16, 24, 32):
            raise ValueError("a key has 16, 24 or 32 bytes")
        return f"base64(aes_encrypt({text}, {quoted(key)}, 'CBC'))"
    if name == "keep":
        return text
    raise ValueError(f"unknown operator {name!r}; there are {', '.join(OPERATORS)}")


def apply_operators(rows: DataFrame, operators: dict[str, tuple[str, dict[str, Any]]], text: str = "text", spans: str = "spans") -> DataFrame:
    """The rows with anonymized, the text with its spans (sorted, apart) rewritten, and items, where each went.

    operators: by entity type, DEFAULT for the rest (replace). items has the places in the new text.
    """
    default = operators.get("DEFAULT", ("replace", {}))
    cases = {t: o for t, o in operators.items() if t != "DEFAULT"}

    def by_type(make) -> str:
        listed = " ".join(f"when {quoted(t)} then {make(o)}" for t, o in cases.items())
        return f"case x.entity_type {listed} else {make(default)} end" if listed else make(default)

    to = by_type(lambda o: operator_sql(o[0], o[1], "x.text", "x.entity_type"))
    used = by_type(lambda o: quoted(o[0]))
    # what is encrypted differs at each evaluation, so both results come out of one fold that is run once
    parts = f"transform({spans}, x -> struct(x.start as start, x.end as end, x.entity_type as entity_type, {used} as operator, {to} as to))"
    item = "named_struct('start', cast(length(acc.out) + p.start - acc.at as int), 'end', cast(length(acc.out) + p.start - acc.at + length(p.to) as int), 'entity_type', p.entity_type, 'operator', p.operator, 'text', p.to)"
    step = f"struct(p.end as at, concat(acc.out, substring({text}, acc.at + 1, p.start - acc.at), p.to) as out, concat(acc.items, array({item})) as items)"
    fold = f"aggregate({parts}, struct(0 as at, cast('' as string) as out, cast(array() as {ITEMS_SQL}) as items), (acc, p) -> {step}, acc -> struct(concat(acc.out, substring({text}, acc.at + 1)) as anonymized, acc.items as items))"
    kept = rows.drop("anonymized", "items")
    return kept.select("*", F.inline(F.array(F.expr(f"if({text} is null, null, {fold})"))))


def deanonymize(text: Column, items: Column, key: str) -> Column:
    """A text with the encrypted items put back; what other operators made stays."""

    def step(acc: Column, p: Column) -> Column:
        own = p["text"]
        plain = F.aes_decrypt(F.unbase64(own), F.lit(key), F.lit("CBC")).cast("string")
        back = F.when(p["operator"] == "encrypt", plain).otherwise(own)
        return F.struct(p["end"].alias("at"), F.concat(acc["out"], text.substr(acc["at"] + 1, p["start"] - acc["at"]), back).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(items, start, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text) - acc["at"])))
