"""Helpers that the corpus operators share: tables, the shared folder, Arrow batches and words."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.shared import Stored, path_exists, shared_dir, store

__all__ = ["Stored", "ascii_words", "change_rows", "blocks_of", "free_shuffles", "give_back", "id_crc", "path_exists", "read_table", "record_batch", "shared_dir", "small_batches", "spread", "store", "text_bytes"]

#: Rows of one Arrow batch that goes to Python; texts may be long, so this is far below Spark's default.
BATCH_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name in a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of this session at BATCH_ROWS rows, so that a worker holds few texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are done: it does so once nothing refers to them any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return to the system what earlier tasks of this worker have freed: workers are reused and keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def spread(spark: SparkSession) -> int:
    """Number of partitions for a shuffle that is dealt out by hand."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_words(text: str | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space, A-Z in lower case. Bytes methods touch ASCII only, as wanted."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column end to end, and the n+1 offsets of its rows in them (null: empty)."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks_of(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.Table]:
    """Consecutive batches joined until their text column holds about that many bytes; one long row stays whole."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(column)).nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def id_crc(column: str = "doc_id"):
    """crc32 of an id as text, which deals rows into folds."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def change_rows(docs: DataFrame, change: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], drop: str | None = None) -> DataFrame:
    """The rows after a function on their Arrow batches, with all their columns, whatever their names.

    Columns go by numbers on the way, since some names (with dots) can't pass; the function sees their own names.
    drop: a column that the function sees last and doesn't give back.
    """
    names = [c for c in docs.columns if c != drop]
    seen = [*names, drop] if drop else names
    inner = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(seen)])
    schema = inner.drop(f"_{len(names)}").schema if drop else inner.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in change(pa.RecordBatch.from_arrays(b.columns, names=seen) for b in batches):
            yield pa.RecordBatch.from_arrays(out.columns, names=[f"_{i}" for i in range(len(names))])

    return inner.mapInArrow(run, schema).toDF(*names)
