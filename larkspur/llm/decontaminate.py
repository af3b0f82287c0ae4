"""Benchmark decontamination: word pairs as seeds that no copy can lack, Smith-Waterman alignment as the judge."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import change_rows, small_batches, store

#: Items of fewer words count only as exact copies: of two words anywhere in a text, of one word as the whole text.
LEAST_WORDS = 3
#: Score that an alignment needs besides its share of a whole copy's: five matching words, or the whole of a shorter item.
LEAST_SCORE = 9
#: Pairs in more places of a block than this are common; COMMON_SHARE of an item's places may go without seeds for that.
COMMON = 64
COMMON_SHARE = 0.2
#: Words of a document that are searched at once, besides the reach of the longest item.
SLICE = 1 << 16
MATCH, MISMATCH, GAP = 2, -1, -1
#: Alignment score as a share of a whole copy's, from which a document counts as contaminated.
THRESHOLD = 0.4
#: Text of benchmark items that goes to the workers at once; larger benchmarks are searched in as many rounds as they have blocks.
BLOCK_BYTES = 8 << 20
#: Cells of score rows that are filled at once: alignments of like size are made together.
ALIGN_CELLS = 1 << 15
_WORDS = re.compile(r"\w+")
#: For texts in ASCII: capitals to small letters, and what is in no word to blanks.
_PLAIN = bytes(ord(chr(c).lower()) if _WORDS.match(chr(c)) and c < 128 else 32 for c in range(256))
_MIX = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    if text.isascii():  # the same several times as quick
        return text.encode().translate(_PLAIN).decode().split()
    return _WORDS.findall(text.lower())


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment of two word-number arrays: its score, and where in the passage it ends (inclusive)."""
    at = np.arange(len(passage) + 1)
    row, best, end = np.zeros(len(passage) + 1, np.int64), 0, -1
    for word in item:
        step = np.zeros_like(row)
        step[1:] = np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(step, 0, out=step)
        row = np.maximum.accumulate(step - GAP * at) + GAP * at
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top - 1
    return best, end


def align_all(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """align for each of many pairs (item, passage), those of like size together.

    What fills the shorter ones up matches nothing, and so never scores above the best that is before it.
    """
    out: list[tuple[int, int]] = [(0, -1)] * len(pairs)
    order = sorted((k for k, (item, passage) in enumerate(pairs) if len(item) and len(passage)), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])), reverse=True)
    while order:
        n = max(1, ALIGN_CELLS // (len(pairs[order[0]][1]) + 1))
        some, order = order[:n], order[n:]
        width, height = len(pairs[some[0]][1]), max(len(pairs[k][0]) for k in some)
        items, passages = np.full((height, len(some), 1), -1, np.int64), np.full((len(some), width), -2, np.int64)
        for r, k in enumerate(some):
            items[: len(pairs[k][0]), r, 0] = pairs[k][0]
            passages[r, : len(pairs[k][1])] = pairs[k][1]
        slope = GAP * np.arange(width + 1, dtype=np.int32)
        row, best, end, each = np.zeros((len(some), width + 1), np.int32), np.zeros(len(some), np.int32), np.full(len(some), -1), np.arange(len(some))
        step = np.zeros_like(row)
        for word in items:
            same = np.where(passages == word, np.int32(MATCH), np.int32(MISMATCH))
            same += row[:, :-1]
            np.maximum(same, row[:, 1:] + np.int32(GAP), out=same)
            np.maximum(same, 0, out=step[:, 1:])
            step -= slope
            np.maximum.accumulate(step, axis=1, out=row)
            row += slope
            top = row.argmax(1)
            score = row[each, top]
            up = score > best
            best[up], end[up] = score[up], top[up] - 1
        for k, b, e in zip(some, best.tolist(), end.tolist(), strict=True):
            out[k] = (b, e)
    return out


class Matcher:
    """The items of one block of a benchmark, with their seeds: (item_id, text, how often the benchmark has it).

    Seeds are pairs of words, next to each other or with one word between, in the item as in the document. They can't
    miss a copy: between two matches that follow each other, an alignment skips i words of the item and j of the
    document at a cost of max(i, j) at least, so k matches with a score of s leave k - 1 steps of costs c with
    sum(2 - c) >= s - 2. A step of cost 0 is a seed of weight 2 and one of cost 1 a seed of weight 1, all others count
    nothing or less: the seeds of an alignment weigh s - 2 or more. Its length in the document is below 3 k - s, with
    k at most the item's length. A place of the item without seeds takes 2 from the weight that is asked, at most.
    """

    def __init__(self, items: list[tuple[int | None, str | None, int]]):
        self.numbers: dict[str, int] = {}
        self.items: list[tuple[int | None, np.ndarray]] = []
        self.often: list[int] = []
        self.short: dict[tuple[str, ...], list[tuple[int | None, int]]] = defaultdict(list)
        for item_id, text, often in items:
            words = words_of(text)
            if 0 < len(words) < LEAST_WORDS:
                self.short[tuple(words)].append((item_id, often))
            elif words:
                self.often.append(often)
                self.items.append((item_id, np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.int64)))
        self.base = len(self.numbers) + 1
        sizes = np.array([len(words) for _, words in self.items], np.int64)
        least = np.maximum(np.ceil(THRESHOLD * MATCH * sizes - 1e-6).astype(np.int64), np.minimum(MATCH * sizes, LEAST_SCORE))
        self.scores = least
        self.reach = 3 * sizes - least
        pairs = [self._pairs(words) for _, words in self.items]
        keys = np.concatenate([k for k, _, _ in pairs]) if pairs else np.zeros(0, np.int64)
        item = np.repeat(np.arange(len(pairs)), [len(k) for k, _, _ in pairs])
        known, which, spread = np.unique(keys, return_inverse=True, return_counts=True)
        stays, dropped, at = np.ones(len(keys), bool), np.zeros(len(pairs), np.int64), 0
        for i, (own, places, _) in enumerate(pairs):
            part = slice(at, at + len(own))
            at += len(own)
            most = int(COMMON_SHARE * sizes[i]) if 2 * int(COMMON_SHARE * sizes[i]) < least[i] - 2 else 0
            common = np.zeros(sizes[i], np.int64)
            np.maximum.at(common, places, spread[which[part]])
            gone = [w for w in np.argsort(-common, kind="stable")[:most].tolist() if common[w] > COMMON]
            stays[part] = ~np.isin(places, gone)
            dropped[i] = len(gone)
        self.least = np.maximum(least - 2 - 2 * dropped, 1)
        order = np.argsort(which[stays], kind="stable")
        self.keys, counts = np.unique(keys[stays], return_counts=True)
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.post_item = item[stays][order]
        self.post_next = np.concatenate([n for _, _, n in pairs])[stays][order] if pairs else np.zeros(0, bool)
        self.shift = 64 - min(26, max(10, int(8 * len(self.keys)).bit_length()))
        self.maybe = np.zeros(1 << (64 - self.shift), bool)
        self.maybe[self._slot(self.keys)] = True

    def _pairs(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, place of its first word, are they next to each other) of all pairs of words at most one word apart."""
        n = len(words)
        first = words * self.base
        keys = np.concatenate([first[:-1] + words[1:], first[:-2] + words[2:]])
        return keys, np.concatenate([np.arange(n - 1), np.arange(n - 2)]), np.arange(2 * n - 3) < n - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(_MIX)) >> np.uint64(self.shift)).view(np.int64)

    def _candidates(self, coded: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first word of a stretch) for the stretches of an item's reach in which its seeds weigh enough.

        stop: where each word's text ends; a stretch ends there at the latest.
        """
        none = np.zeros(0, np.int64)
        n = len(coded)
        if n < 2:
            return none, none
        keys, places, near = self._pairs(coded)
        some = np.nonzero(self.maybe[self._slot(keys)])[0]
        key = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        hit = self.keys[key] == keys[some]
        key, some = key[hit], some[hit]
        if not len(key):
            return none, none
        counts = self.starts[key + 1] - self.starts[key]
        each = np.repeat(np.arange(len(key)), counts)
        post = np.arange(len(each)) + (self.starts[key] - np.cumsum(counts) + counts)[each]
        light = ~(self.post_next[post] & near[some][each])
        marks = np.sort((self.post_item[post] * n + places[some][each]) * 2 + light)
        marks = marks[np.concatenate([[True], marks[1:] >> 1 != marks[:-1] >> 1])]  # a word counts once, by its best pair
        weight, where = 2 - (marks & 1), marks >> 1
        item = where // n
        total = np.concatenate([[0], np.cumsum(weight)])
        end = np.searchsorted(where, np.minimum(where + self.reach[item], item * n + stop[where % n]))
        enough = total[end] - total[:-1] >= self.least[item]
        return item[enough], where[enough] % n

    def _short_copies(self, words: list[str]) -> list[tuple[int | None, float, int, int, int]]:
        """Exact copies of the items of one or two words, at their first places."""
        found = [(i, 1.0, 0, 0, often) for i, often in self.short.get(tuple(words), [])] if len(words) == 1 else []
        seen = set()
        for k, pair in enumerate(pairwise(words)):
            if pair in self.short and pair not in seen:
                seen.add(pair)
                found += [(i, 1.0, k, k + 1, often) for i, often in self.short[pair]]
        return found

    def matches(self, text: str | None) -> list[tuple[int | None, float, int, int, int]]:
        """matches_all of one text."""
        return self.matches_all([text])[0]

    def matches_all(self, texts: list[str | None]) -> list[list[tuple[int | None, float, int, int, int]]]:
        """For each text (item_id, score, first and last word of the passage, how often) of the items that it contains.

        The score is that of the best alignment with the whole text, as a share of a whole copy's. It counts from
        THRESHOLD and LEAST_SCORE on: every alignment that counts has seeds enough, and lies within the item's reach
        of each of them.
        """
        found: list[list[tuple[int | None, float, int, int, int]]] = []
        tried: list[tuple[int, int, np.ndarray, int]] = []
        coded, size = [], 0
        for text in texts:
            words = words_of(text)
            found.append(self._short_copies(words) if self.short else [])
            if self.items:
                coded.append(np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, len(words)))
                size += len(words)
                if size >= SLICE or len(found) == len(texts):
                    tried += self._passages(coded, len(found) - len(coded))
                    coded, size = [], 0
        best: dict[tuple[int, int], tuple[int, int, np.ndarray, int]] = {}
        for (score, end), (k, i, passage, a) in zip(align_all([(self.items[i][1], passage) for _, i, passage, _ in tried]), tried, strict=True):
            if score >= self.scores[i] and score > best.get((k, i), (0,))[0]:
                best[k, i] = (score, end, passage, a)
        backs = align_all([(self.items[i][1][::-1], passage[: end + 1][::-1]) for (_, i), (_, end, passage, _) in best.items()])
        for ((k, i), (score, end, _, a)), (_, back) in zip(best.items(), backs, strict=True):
            item_id, item = self.items[i]
            found[k].append((item_id, score / (MATCH * len(item)), a + end - back, a + end, self.often[i]))
        return found

    def _passages(self, coded: list[np.ndarray], at: int) -> list[tuple[int, int, np.ndarray, int]]:
        """(text, item, words, place of the first) of the passages in which an alignment may be that counts.

        at: the number of the first text. The texts are searched as one, with two unknown words between them, so that no pair is of two texts.
        """
        sizes = np.array([len(x) for x in coded], np.int64)
        ends = np.cumsum(sizes + 2) - 2
        own = np.repeat(np.arange(len(coded)), sizes + 2)
        stop = ends[own]
        words = np.concatenate([y for x in coded for y in (x, np.zeros(2, np.int64))])
        over = int(self.reach.max()) + 2
        step = max(SLICE, over)
        passages: dict[tuple[int, int], list[list[int]]] = defaultdict(list)
        for start in range(0, len(words), step):
            some = slice(start, start + step + over)
            n = len(words[some])
            items, places = self._candidates(words[some], np.minimum(stop[some] - start, n))
            texts = own[start + places]
            first = (ends - sizes)[texts]
            low, high = np.maximum(first, start + places - self.reach[items]), np.minimum(ends[texts], start + places + self.reach[items] + 2)
            for k, i, a, b in zip(*(x.tolist() for x in (texts, items, low - first, high - first)), strict=True):
                last = passages[k, i]
                if last and a <= last[-1][1]:
                    last[-1][1] = max(last[-1][1], b)
                    last[-1][0] = min(last[-1][0], a)
                else:
                    last.append([a, b])
        return [(at + k, i, coded[k][a:b], a) for (k, i), spans in passages.items() for a, b in spans]


def _blocks(benchmark: DataFrame) -> Iterator[Matcher]:
    """The benchmark in blocks of about BLOCK_BYTES text, dealt by a hash, one at a time. Equal rows are one, counted."""
    rows = benchmark.where("text is not null").groupBy(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).agg(F.count(F.lit(1)).alias("often"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-size // BLOCK_BYTES) or 1
    for k in range(n):
        part = (rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows).collect()
        yield Matcher(sorted(((r["item_id"], r["text"], r["often"]) for r in part), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def _in_rounds(rows: DataFrame, benchmark: DataFrame, search: Callable[[DataFrame, Callable[[list[str | None]], list[list]]], DataFrame]) -> DataFrame:
    """Apply a search to the rows for each block of the benchmark; between rounds the rows are stored.

    So a worker holds one block at a time, however large the benchmark.
    """
    before = None
    blocks = _blocks(benchmark)
    block = next(blocks)
    while block:
        held = rows.sparkSession.sparkContext.broadcast(block)
        rows = search(rows, lambda texts, held=held: held.value.matches_all(texts))
        block = next(blocks, None)
        if block:
            after = store(rows, "searched")
            held.destroy()
            if before:
                before.drop()
            rows, before = after.df, after
    return rows


def _order(hit: tuple) -> tuple:
    """Hits from the best on: by score, then the smallest id, one without an id last."""
    return (-hit[1], hit[0] is None, hit[0] or 0)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Which documents contain a benchmark item, whole, edited or in large part.

    Returns a row for each document: doc_id, n_items (items found), best_item and best_score (the item with the best
    alignment, the smallest id of equals, and its share of a whole copy's score; null and 0 if none), first_word and
    last_word (its passage, counted in words from 0), contaminated. The whole text is searched for every item; an item
    counts if an alignment has THRESHOLD of a whole copy's score and five matching words, or, of items with fewer
    words, if all its words are there. An item of two words counts as an exact copy anywhere, one of a single word only as the
    whole text, since a lone word inside a text is no copy. Null and empty texts contain nothing; repeated rows get a
    row each; an item that occurs twice in the benchmark counts twice, one without an id counts without a name; items
    without a word are no items; other columns are ignored; an empty benchmark leaves all clean. The items go to the
    documents in blocks of a fixed size, so no document moves and a popular item skews nothing.
    """
    small_batches(docs.sparkSession)
    none = [F.lit(0).cast("long").alias("n_items"), F.lit(None).cast("long").alias("best_item"), F.lit(0.0).alias("best_score"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *none)
    schema = rows.schema

    def search(rows: DataFrame, matches: Callable[[list[str | None]], list[list]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                old = zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True)
                out = []
                for hits, (n, item, score, first, last) in zip(matches(batch.column(1).to_pylist()), old, strict=True):
                    best = min([*hits, *([(item, score, first, last, 0)] if n else [])], key=_order, default=(None, 0.0, None, None, 0))
                    out.append((n + sum(h[4] for h in hits), *best[:4]))
                if out:
                    made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=schema.names)

        return rows.mapInArrow(run, schema)

    found = _in_rounds(rows, benchmark, search)
    return found.drop("text").withColumn("contaminated", F.col("n_items") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a benchmark item, with all their columns; no row moves."""
    small_batches(docs.sparkSession)

    def search(rows: DataFrame, matches: Callable[[list[str | None]], list[list]]) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array([not hits for hits in matches(texts)], pa.bool_()))

        return change_rows(rows, keep)

    return _in_rounds(docs, benchmark, search)
