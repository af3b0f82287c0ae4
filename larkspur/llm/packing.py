"""Packing of documents into sequences of a fixed length: exact complements first, best fit for the rest."""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_of, give_back, record_batch, small_batches, store
from .tokens import WordIds, tokenizer_path

CAPACITY = 4096
END_ID = 1
#: Bytes of text whose ids are found at once: that takes about 20 times as much memory in a worker.
_BLOCK = 2 << 20
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])
_PLACED = pa.schema([*list(_PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])
_SHIFT = 40


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Cut every document's ids, with the end id, into pieces; part and nth number the pieces of a length in a task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        words, part, seen = WordIds(path), TaskContext.get().partitionId(), defaultdict(int)
        for block in blocks_of(batches, "text", _BLOCK):
            ids, bounds = words.texts(block.column("text").combine_chunks())
            rows = []
            for doc, a, b in zip(block.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(END_ID)).astype("<u4", copy=False)
                for k, at in enumerate(range(0, len(own), capacity)):
                    piece = own[at : at + capacity]
                    rows.append((doc, k, at, len(piece), zlib.crc32(piece.tobytes()), part, seen[len(piece)]))
                    seen[len(piece)] += 1
            if rows:
                yield record_batch(_PIECES, *zip(*rows, strict=True))

    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


class _Plan:
    """Groups of like sequences: how many, and the lengths in each."""

    def __init__(self, capacity: int, counts: np.ndarray):
        self.capacity, self.left, self.groups = capacity, counts, []

    def take(self, lengths: list[int]) -> int:
        """Fill as many sequences as there are pieces for with these lengths; returns how many."""
        need: dict[int, int] = defaultdict(int)
        for x in lengths:
            need[x] += 1
        many = min(int(self.left[x]) // n for x, n in need.items())
        if many:
            for x, n in need.items():
                self.left[x] -= many * n
            self.groups.append((many, lengths))
        return many


def _exact_pair(left: np.ndarray, total: int) -> Iterator[tuple[int, int]]:
    """Lengths a >= b with the sum total of which there are pieces; the longest a first."""
    if total < 2:
        return
    there = left[: total + 1] > 0
    low = (total + 1) // 2
    for a in (np.nonzero(there[low:total] & there[total - low : 0 : -1])[0] + low)[::-1].tolist():
        yield a, total - a


def plan_sequences(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """counts[n]: pieces of length n, n up to the capacity. Returns groups (how many sequences, lengths in each).

    From the longest pieces down, each length's gap is looked up among the sums of one, two and three lengths and
    filled by combinations that fit exactly, as often as pieces allow. What stays is placed by best fit, the longest
    first. All steps move whole counts, so the work depends on the capacity and not on the number of pieces.
    """
    plan = _Plan(capacity, counts.astype(np.int64).copy())
    left = plan.left
    for x in range(capacity, 0, -1):
        if not left[x]:
            continue
        gap = capacity - x
        if not gap:
            plan.take([x])
            continue
        if left[gap]:
            plan.take([x, gap])
        for a, b in _exact_pair(left, gap):
            if not left[x]:
                break
            plan.take([x, a, b])
        for a in np.nonzero(left[:gap] > 0)[0][::-1].tolist():
            if not left[x]:
                break
            if 3 * a < gap:  # a is the longest of the three
                break
            for b, c in _exact_pair(left, gap - a):
                if not left[x] or not left[a]:
                    break
                if b <= a:
                    plan.take([x, a, b, c])
    return plan.groups + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Best fit decreasing over counts: equal gaps are groups (how many, lengths)."""
    by_gap: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    gaps: list[int] = []

    def put(many: int, lengths: list[int], gap: int) -> None:
        if gap not in by_gap or not by_gap[gap]:
            bisect.insort(gaps, gap)
        by_gap[gap].append((many, lengths))

    for x in np.nonzero(left)[0][::-1].tolist():
        n = int(left[x])
        while n:
            at = bisect.bisect_left(gaps, x)
            if at == len(gaps):
                each = capacity // x
                if n >= each:
                    put(n // each, [x] * each, capacity - each * x)
                if n % each:
                    put(1, [x] * (n % each), capacity - n % each * x)
                break
            gap = gaps[at]
            many, lengths = by_gap[gap].pop()
            used = min(many, n)
            if many > used:
                by_gap[gap].append((many - used, lengths))
            if not by_gap[gap]:
                gaps.pop(at)
            put(used, [*lengths, x], gap - x)
            n -= used
    left[:] = 0
    return [group for groups in by_gap.values() for group in groups]


def _slots(groups: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by length and rank: where a run of ranks starts, the first of its sequences, and its offset in them."""
    next_rank, base = defaultdict(int), 0
    rows = []
    for many, lengths in groups:
        offset = 0
        for x in lengths:
            rows.append(((x << _SHIFT) + next_rank[x], base, offset))
            next_rank[x] += many
            offset += x
        base += many
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents into few sequences of at most capacity tokens.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is its end id
    alone; a text of capacity ids gives a second piece with the end id. Repeated rows are packed each time; rows
    without a doc_id too, with a null there; other columns are ignored; an empty table gives an empty one. The driver sees the
    count of each length, at most capacity numbers, and its plan has a size that follows from the capacity.
    """
    path = path or tokenizer_path()
    cut = store(pieces(docs, path, capacity), "pieces").df
    counts = np.zeros(capacity + 1, np.int64)
    for x, n in cut.groupBy("length").count().collect():
        counts[x] = n
    groups = plan_sequences(counts, capacity)
    plan = docs.sparkSession.sparkContext.broadcast(_slots(groups))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy("part", "length").count().select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, base, offset = plan.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            key = (length << _SHIFT) + rank
            at = np.searchsorted(keys, key, "right") - 1
            yield record_batch(_PLACED, *batch.columns[:5], base[at] + key - keys[at], offset[at])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
