"""Token totals by source, language and tokenizer version, kept up by signed deltas in idempotent batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.shared import file_system

from .common import ascii_words, blocks_of, path_exists, record_batch, small_batches
from .tokens import WordIds, tokenizer_path

KEYS = ["source", "lang", "tokenizer"]
MEASURES = ["n_docs", "n_tokens", "n_chars"]
_BLOCK = 8 << 20
_COUNTED = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("tokenizer", pa.string()), ("n_tokens", pa.int64()), ("n_chars", pa.int64())])


def production_tokenizers() -> dict[str, str | None]:
    """Tokenizer versions to the files of their vocabularies; None: words between ASCII white space."""
    return {"whitespace-1": None, "word_bpe_49k-1": tokenizer_path()}


def counted(docs: DataFrame, tokenizers: Mapping[str, str | None]) -> DataFrame:
    """A row for each document and tokenizer version: its tokens and code points. Null texts count as empty."""
    versions = dict(tokenizers)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = {name: WordIds(path) if path else None for name, path in versions.items()}
        for block in blocks_of(batches, "text", _BLOCK):
            texts = block.column("text").combine_chunks()
            doc, source, lang, chars = (block.column(c).combine_chunks() for c in ("doc_id", "source", "lang", "n_chars"))
            for name, coder in coders.items():
                n = np.diff(coder.texts(texts)[1]) if coder else [len(ascii_words(t)) for t in texts.to_pylist()]
                yield record_batch(_COUNTED, doc, source, lang, [name] * len(doc), n, chars)

    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), text.alias("text"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"))
    return rows.mapInArrow(count, "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_chars long")


def _signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (F.col("n_tokens") * sign).alias("n_tokens"), (F.col("n_chars") * sign).alias("n_chars"))


def inserts(rows: DataFrame) -> DataFrame:
    """Deltas of counted documents that arrive."""
    return _signed(rows, 1)


def deletes(rows: DataFrame) -> DataFrame:
    """Deltas of counted documents that go."""
    return _signed(rows, -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas of documents whose counts, source or language change: what they counted goes, what they count comes."""
    return deletes(old).unionByName(inserts(new))


class TokenRollup:
    """A ledger of committed batches in a shared folder; the totals are sums over it.

    A batch is summed by key before it is written, so its size follows the number of keys. It is written beside the
    ledger and renamed into it, which happens as a whole or not at all: a batch that broke off isn't seen and can be
    sent again, one that is there isn't applied twice, and of two writers of one batch one wins (on file systems whose
    renames are atomic). Null sources and languages are keys like others. compact() replaces batches by their sum.
    """

    _SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, batch_id: str) -> str:
        if not re.fullmatch(r"[\w.-]+", batch_id):
            raise ValueError(f"a batch id has letters, digits, '_', '-' and '.' only: {batch_id!r}")
        return f"{self.path}/batch={batch_id}"

    def _names(self, folder: str) -> list[str]:
        files, where = file_system(self.spark, folder)
        return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """The newest sum of batches, and the ids of the batches in it."""
        done = [n for n in self._names(self.path) if n.startswith("snapshot=")]
        if not done:
            return None, set()
        newest = f"{self.path}/{max(done)}"
        return newest, {r["batch_id"] for r in self.spark.read.schema("batch_id string").parquet(f"{newest}/ids").collect()}

    def is_committed(self, batch_id: str) -> bool:
        return path_exists(self.spark, self._folder(batch_id)) or batch_id in self._snapshot()[1]

    def _move(self, source: str, target: str) -> bool:
        """Rename a folder unless the target is there; what came second goes."""
        files, where = file_system(self.spark, target)
        mine = file_system(self.spark, source)[1]
        moved = not files.exists(where) and bool(files.rename(mine, where))
        # a rename onto a folder that another writer has just made puts ours inside it
        inside = file_system(self.spark, f"{target}/{source.rsplit('/', 1)[-1]}")[1]
        if files.exists(inside):
            files.delete(inside, True)
            moved = False
        files.delete(mine, True)
        return moved

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add a batch of deltas once; False if it was there."""
        if self.is_committed(batch_id):
            return False
        pending = f"{self.path}-pending/{uuid.uuid4().hex}"
        deltas.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES]).write.parquet(pending)
        files, root = file_system(self.spark, self.path)
        files.mkdirs(root)
        return self._move(pending, self._folder(batch_id))

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        return sorted({n.removeprefix("batch=") for n in self._names(self.path) if n.startswith("batch=")} | self._snapshot()[1])

    def _sums(self) -> tuple[DataFrame, set[str]]:
        snapshot, inside = self._snapshot()
        here = {n.removeprefix("batch=") for n in self._names(self.path) if n.startswith("batch=")}
        folders = [f"{snapshot}/sums"] * (snapshot is not None) + [self._folder(i) for i in sorted(here - inside)]
        rows = self.spark.read.schema(self._SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], self._SCHEMA)
        return rows.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES]), here | inside

    def compact(self) -> None:
        """Write the sum of all batches with their ids, then delete what it replaces. One writer at a time."""
        sums, ids = self._sums()
        old = self._names(self.path)
        pending = f"{self.path}-pending/{uuid.uuid4().hex}"
        sums.write.parquet(f"{pending}/sums")
        self.spark.createDataFrame([(i,) for i in sorted(ids)], "batch_id string").write.parquet(f"{pending}/ids")
        number = 1 + max((int(n.removeprefix("snapshot=")) for n in old if n.startswith("snapshot=")), default=0)
        if not self._move(pending, f"{self.path}/snapshot={number:012d}"):
            raise RuntimeError("another writer has compacted this ledger")
        for name in old:
            files, where = file_system(self.spark, f"{self.path}/{name}")
            files.delete(where, True)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, n_chars over all committed batches; keys without documents go."""
        return self._sums()[0].where("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")
