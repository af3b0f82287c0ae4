"""Rehydration of streamed chunks: a buffer for each thread holds back what may be the beginning of a token."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.operators.vault import CASE

OUT_SQL = "tenant_id string, case_id string, thread_id string, chunk_seq long, chunk string, last boolean"
STATE_SQL = "buffer string, next_seq long, waiting string"


def feed(buffer: str, chunk: str, tokens: dict[str, str]) -> tuple[str, str]:
    """(what can go out, what stays): the leftmost token is replaced first, the longest of those at a place."""
    held, out = buffer + chunk, []
    order = sorted(tokens, key=len, reverse=True)
    at = 0
    while at < len(held):
        rest = held[at:]
        token = next((t for t in order if rest.startswith(t)), None)
        if token is None:
            if any(t.startswith(rest) for t in order):
                break
            out.append(held[at])
            at += 1
        elif len(rest) < len(order[0]) and any(t != token and t.startswith(rest) for t in order):
            break
        else:
            out.append(tokens[token])
            at += len(token)
    return "".join(out), held[at:]


def rehydrate_stream(chunks: list[str], tokens: dict[str, str]) -> Iterator[str]:
    """Chunks of one thread on the driver; empty pieces aren't given out."""
    buffer = ""
    for chunk in chunks:
        out, buffer = feed(buffer, chunk, tokens)
        if out:
            yield out
    if buffer:
        out, rest = feed(buffer, "\0", tokens)
        yield (out + rest).removesuffix("\0")


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    buffer, due, waiting = state.get if state.exists else ("", 0, "{}")
    late = {int(k): tuple(v) for k, v in json.loads(waiting).items()}
    mapping: dict[str, str] = {}
    for frame in frames:
        for seq, chunk, last, pairs in frame[["chunk_seq", "chunk", "last", "mapping"]].itertuples(index=False):
            late[int(seq)] = (chunk, bool(last))
            mapping.update({p["key"]: p["value"] for p in pairs})
    out, ended = [], False
    while due in late:
        chunk, ended = late.pop(due)
        piece, buffer = feed(buffer, chunk, mapping)
        out.append(piece)
        due += 1
        if ended:
            piece, rest = feed(buffer, "\0", mapping)
            out.append((piece + rest).removesuffix("\0"))
            buffer = ""
            break
    if ended:
        state.remove()
    else:
        state.update((buffer, due, json.dumps({str(k): list(v) for k, v in late.items()})))
    text = "".join(out)
    if text or ended:
        yield pd.DataFrame([(*key, due - 1, text, ended)], columns=["tenant_id", "case_id", "thread_id", "chunk_seq", "chunk", "last"])


def rehydrate_streaming(chunks: DataFrame, mappings: DataFrame) -> DataFrame:
    """Rehydrate a stream of (tenant_id, case_id, thread_id, chunk_seq, chunk, last) with the mappings of its threads.

    chunk_seq counts from 0; chunks that arrive early wait in the state. The last chunk of a thread empties its buffer
    and ends its state. A row of the result has the chunk_seq of the last chunk that it holds.
    """
    entries = mappings.select(*CASE, F.map_entries("mapping").alias("mapping"))
    none = F.array().cast("array<struct<key:string,value:string>>")
    joined = chunks.join(entries, CASE, "left").withColumn("mapping", F.coalesce("mapping", none))
    return joined.groupBy(*CASE).applyInPandasWithState(_advance, OUT_SQL, STATE_SQL, "append", GroupStateTimeout.NoTimeout)
