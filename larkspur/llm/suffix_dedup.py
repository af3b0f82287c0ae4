"""Removal of byte strings that occur earlier in the corpus: suffix arrays per shard, merged across shards.

Equal strings of SPAN bytes have the same smallest inner gram at the same place, their anchor. Each window belongs to
its anchor, and the windows of one anchor to a context of under 2 * SPAN bytes. So only contexts whose anchor occurs
in another context too can hold repeats that aren't repeats of the whole context. Those go to shards by anchor; each
shard has a suffix array. An anchor with very many contexts is dealt to several shards, whose sorted windows are then
merged by binary search.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.shared import join_null_safe, unused

from .common import blocks_of, change_rows, record_batch, small_batches, store, text_bytes
from .suffix_array import window_groups, words_at

SPAN = 100
GRAM = 24
_CHOICES = SPAN - GRAM + 1
#: Contexts of an anchor beyond which they are dealt to several shards.
CROWD = 10_000
#: Bytes of contexts in a shard, about, and windows in a range of digests in which crowded shards are merged, about.
SHARD_BYTES = 1 << 20
RANGE_WINDOWS = 100_000
#: Parts in which the contexts of a hot anchor are compared before those that are first in their part meet.
PARTS = 64
#: One in so many documents is looked at to find anchors with at least the share 1/HOT of all contexts; this only decides where rows go.
SAMPLE, HOT = 64, 20_000
_BLOCK = 2 << 20
_LOW = np.uint64((1 << 22) - 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

_MARKS = pa.schema([("anchor", pa.int64()), ("g1", pa.int64()), ("g2", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("again", pa.bool_())])
_MARKS_SQL = "anchor long, g1 long, g2 long, doc_id long, row long, start long, stop long, again boolean"
_PLACE = ["doc_id", "row", "start"]
_CUTS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
_CUTS_SQL = "doc_id long, row long, start long, stop long"
_CONTEXTS = pa.schema([("shard", pa.int64()), ("crowded", pa.bool_()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])
_FOUND = pa.schema([*_CUTS, ("range", pa.int64()), ("run", pa.binary())])
_RUN = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc_id", "<i8"), ("row", "<i8"), ("start", "<i8")])


def _mix(words: list[np.ndarray], seed: int) -> np.ndarray:
    """A number that says where rows go; nothing is cut because two of these are equal."""
    out = np.full(len(words[0]), np.uint64(seed))
    for w in words:
        out = (out ^ w) * _A
        out ^= out >> np.uint64(32)
    out *= _B
    return out ^ (out >> np.uint64(29))


def digests(raw: bytes, first: np.ndarray, stop: np.ndarray, salt: bytes) -> np.ndarray:
    """BLAKE2b digests of 128 bits of stretches, as two numbers each. The salt is drawn for every run."""
    blake = hashlib.blake2b
    joined = b"".join([blake(raw[a:b], digest_size=16, salt=salt).digest() for a, b in zip(first.tolist(), stop.tolist(), strict=True)])
    return np.frombuffer(joined, "<u8").reshape(-1, 2)


def anchors(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts of texts that lie end to end in at most 4 MB, given their n+1 bounds.

    Returns the text of each context, the number of its anchor, its first and last window start (in raw). A window has
    its leftmost smallest gram as anchor, so contexts are runs of windows, and equal bytes are cut up alike.
    """
    if len(raw) < SPAN:
        return (np.zeros(0, np.int64),) * 4
    words = words_at(raw)
    grams = len(raw) - GRAM + 1
    digest = _mix([words[k : k + grams] for k in range(0, GRAM, 8)], 0)
    least = (digest << np.uint64(22)) | np.arange(grams, dtype=np.uint64)
    width = 1
    while 2 * width <= _CHOICES:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    n, rest = len(raw) - SPAN + 1, _CHOICES - width
    least = np.minimum(least[:n], least[rest : rest + n])
    place = (least & _LOW).astype(np.int64)
    size = np.maximum(np.diff(bounds) - SPAN + 1, 0)  # windows of each text; those across two texts don't count
    text = np.repeat(np.arange(len(size)), size)
    window = np.arange(len(text)) + np.repeat(bounds[:-1] - (np.cumsum(size) - size), size)
    place = place[window]
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    at = np.nonzero(new)[0]
    first, last = window[at], window[np.append(at[1:], len(window))[: len(at)] - 1]
    return text[at], digest[place[at]].view(np.int64), first, last


def _stretches(bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts in groups of about _BLOCK bytes: their numbers and bounds. A longer text comes alone, in stretches that
    overlap by SPAN - 1 bytes, so that each of its windows is seen once."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _BLOCK, "right")) - 1)
        if bounds[to] - bounds[at] <= 2 * _BLOCK:
            yield np.arange(at, to), bounds[at : to + 1]
        else:
            for a in range(bounds[at], bounds[to] - SPAN + 1, _BLOCK):
                yield np.array([at]), np.array([a, min(a + _BLOCK + SPAN - 1, bounds[to])])
        at = to


def _marker(salt: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts of a task's documents. Of those equal within a block the earliest stands for all; the rest is known."""
        for block in blocks_of(batches, "text", _BLOCK):
            raw, bounds = text_bytes(block.column("text").combine_chunks())
            ids, rows = block.column("doc_id").to_numpy(), block.column("row").to_numpy()
            for texts, edges in _stretches(bounds):
                part = raw[edges[0] : edges[-1]]
                text, a, first, last = anchors(part, edges - edges[0])
                if not len(text):
                    continue
                g = digests(part.tobytes(), first, last + SPAN, salt)
                text = texts[text]
                d, r, s, e = ids[text], rows[text], first + edges[0] - bounds[text], last + edges[0] - bounds[text] + SPAN
                order = np.lexsort((s, r, d, g[:, 1], g[:, 0]))
                a, g, d, r, s, e = a[order], g[order], d[order], r[order], s[order], e[order]
                new = np.ones(len(a), bool)
                new[1:] = (g[1:] != g[:-1]).any(1)
                head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
                again = (d != d[head]) | (r != r[head]) | (s != s[head])
                to = np.where(again, _mix([d.view(np.uint64), s.astype(np.uint64)], 6).view(np.int64), a)
                yield record_batch(_MARKS, to, g[:, 0].view(np.int64), g[:, 1].view(np.int64), d, r, s, e, again)

    return mark


def _hot_anchors(texts: DataFrame, mark: Callable) -> DataFrame:
    """Anchors with a large share of the contexts of a sample of documents: at most HOT of them, by the share's size."""
    seen = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).mapInArrow(mark, _MARKS_SQL).where("not again").groupBy("anchor").count().where("count >= 5")
    seen = store(seen, "anchors").df
    least = (seen.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]) / HOT
    return seen.where(F.col("count") >= max(5, least)).select("anchor")


def _contested(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cuts, contested): contexts that are repeats as a whole, and those to be compared with others of their anchor.

    One shuffle deals contexts by anchor. A hot anchor's are dealt by their own digest and in PARTS; those that are
    first in their part meet in a second, small shuffle. All of them count as contested.
    """
    mark = _marker(os.urandom(16))
    hot = F.broadcast(_hot_anchors(texts, mark).withColumn("hot", F.lit(True)))
    marks = texts.mapInArrow(mark, _MARKS_SQL).join(hot, "anchor", "left").withColumn("hot", F.col("hot").isNotNull())
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    routed = marks.withColumn("to", F.when(F.col("hot"), F.xxhash64("anchor", "g1", part)).otherwise(F.col("anchor")))
    by_anchor = Window.partitionBy("to")
    same = Window.partitionBy("to", "g1", "g2").orderBy(*_PLACE)
    several = (F.min("g1").over(by_anchor) != F.max("g1").over(by_anchor)) | (F.min("g2").over(by_anchor) != F.max("g2").over(by_anchor))
    told = routed.select("anchor", "g1", "g2", *_PLACE, "stop", "hot", (F.col("again") | (F.rank().over(same) > 1)).alias("again"), (F.col("hot") | several).alias("contested"))
    kept = store(told.where("again or contested"), "contexts").df
    rivals = Window.partitionBy("anchor", "g1", "g2").orderBy(*_PLACE)
    met = kept.where("hot and not again").withColumn("again", F.rank().over(rivals) > 1)
    kept = store(kept.where("again or not hot").unionByName(met), "contested").df
    return kept.where("again").select("doc_id", "row", "start", "stop"), kept.where("not again").select("anchor", "g1", *_PLACE, "stop")


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def _merge_starts(doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows to maximal stretches (doc, row, start, stop)."""
    order = np.lexsort((start, row, doc))
    doc, row, start = doc[order], row[order], start[order]
    new = _new(doc, row)
    new[1:] |= start[1:] > start[:-1] + SPAN
    ends = np.append(new[1:], True)[: len(new)]
    return doc[new], row[new], start[new], start[ends] + SPAN


def _not_first(group: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by group, document and start, and which of it isn't at the group's earliest place."""
    order = np.lexsort((start, row, doc, group))
    d, r, s = doc[order], row[order], start[order]
    head = np.maximum.accumulate(np.where(_new(group[order]), np.arange(len(order)), 0))
    return order, (d != d[head]) | (r != r[head]) | (s != s[head])


def _search_shard(table: pa.Table, range_bits: int, salt: bytes) -> Iterator[pa.RecordBatch]:
    """Repeats inside a shard; of a crowded anchor's shard also its distinct windows, sorted, in ranges of their digests."""
    texts = table.column("bytes").combine_chunks()
    raw, bounds = text_bytes(texts.cast(pa.large_binary()).view(pa.large_string()))
    size = np.diff(bounds)
    valid = np.zeros(len(raw), bool)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        valid[a : max(a, b - SPAN + 1)] = True  # a stretch shorter than a window has none
    which = np.repeat(np.arange(len(size), dtype=np.int32), size)
    docs, rows, starts = (table.column(c).to_numpy() for c in ("doc_id", "row", "start"))
    at, group = window_groups(raw, valid, SPAN)
    own = which[at]
    del which, valid
    doc, row, place = docs[own], rows[own], starts[own] - bounds[own] + at
    order, late = _not_first(group, doc, row, place)
    cut = order[late]
    found = _merge_starts(doc[cut], row[cut], place[cut])
    nothing = [None] * len(found[0])
    yield record_batch(_FOUND, *found, nothing, nothing)
    if table.column("crowded")[0].as_py():
        kept = order[~late]
        run = np.empty(len(kept), _RUN)
        run["a"], run["b"] = digests(raw.tobytes(), at[kept], at[kept] + SPAN, salt).T
        run["doc_id"], run["row"], run["start"] = doc[kept], row[kept], place[kept]
        run = run[np.lexsort((run["b"], run["a"]))]
        edges = np.arange(1, 1 << range_bits, dtype=np.uint64) << np.uint64(64 - range_bits) if range_bits else np.zeros(0, np.uint64)
        parts = np.split(run, np.searchsorted(run["a"], edges))
        parts = [(k, p.tobytes()) for k, p in enumerate(parts) if len(p)]
        nothing = [None] * len(parts)
        yield record_batch(_FOUND, nothing, nothing, nothing, nothing, [k for k, _ in parts], [p for _, p in parts])


def _merged(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs as one, and the windows that are in both, at the later of their places.

    Each window of the shorter run is looked up in the longer one by binary search.
    """
    if len(one) < len(two):
        one, two = two, one
    lo = np.searchsorted(one["a"], two["a"], "left")
    there = np.zeros(len(two), bool)
    while True:  # equal first halves are next to each other; nearly always there is one at most
        ok = (lo < len(one)) & ~there
        ok[ok] = one["a"][lo[ok]] == two["a"][ok]
        if not ok.any():
            break
        there[ok] = one["b"][lo[ok]] == two["b"][ok]
        lo[ok & ~there] += 1
    old, own = one[lo[there]], two[there]
    keys = [(own[c], old[c]) for c in _PLACE]
    less, equal = np.zeros(len(own), bool), np.ones(len(own), bool)
    for x, y in keys:
        less |= equal & (x < y)
        equal &= x == y
    late = np.concatenate([old[less], own[~less & ~equal]])
    if less.any():
        one = one.copy()
        one[lo[there][less]] = own[less]
    fresh = two[~there]
    return np.insert(one, np.searchsorted(one["a"], fresh["a"], "left"), fresh), late


def _merge_runs(table: pa.Table) -> pa.Table:
    """One range of all crowded shards: runs are merged two at a time, the shortest first."""
    heap = [(len(r), k, r) for k, r in enumerate(np.frombuffer(blob, _RUN) for blob in table.column("run").to_pylist())]
    heapq.heapify(heap)
    late, n = [np.empty(0, _RUN)], len(heap)
    while len(heap) > 1:
        one, two = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both, gone = _merged(one, two)
        late.append(gone)
        heapq.heappush(heap, (len(both), n, both))
        n += 1
    gone = np.concatenate(late)
    return pa.table([pa.array(c, pa.int64()) for c in _merge_starts(gone["doc_id"], gone["row"], gone["start"])], schema=_CUTS)


def _shard_contexts(contested: DataFrame, texts: DataFrame) -> tuple[DataFrame, int]:
    """The bytes of contested contexts with the shard that each goes to, and in how many ranges crowded shards meet (log2)."""
    # stored, so that the join has exchanges of its own and a crowded anchor can be split
    crowd = store(contested.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD), "crowds").df
    crowded = crowd.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = contested.agg(F.count(F.lit(1))).first()[0]
    shards = counts * 3 * SPAN // 2 // SHARD_BYTES + 1
    dealt = contested.join(crowd, "anchor", "left")
    own = F.concat(F.lit("c"), F.col("anchor"), F.lit("-"), F.pmod("g1", F.ceil(F.col("n") / CROWD).cast("long")))
    shard = F.when(F.col("n").isNull(), F.pmod("anchor", F.lit(shards))).otherwise(F.xxhash64(own).bitwiseOR(F.lit(1 << 62)))
    wanted = dealt.select("doc_id", "row", F.struct("start", "stop", shard.alias("shard"), F.col("n").isNotNull().alias("crowded")).alias("w")).groupBy("doc_id", "row").agg(F.collect_list("w").alias("w"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, row, text, wants in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode()
                rows += [(w["shard"], w["crowded"], doc, row, w["start"], raw[w["start"] : w["stop"]]) for w in wants]
            if rows:
                yield record_batch(_CONTEXTS, *zip(*rows, strict=True))

    found = texts.join(wanted, ["doc_id", "row"]).mapInArrow(cut, "shard long, crowded boolean, doc_id long, row long, start long, bytes binary")
    return found, (crowded * _CHOICES // 2 // RANGE_WINDOWS).bit_length()


def _with_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): row is 0, and where rows with unlike texts have one id, a number that tells the texts apart."""
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    mark = F.xxhash64("text")
    unlike = store(small.where("doc_id is not null").groupBy("doc_id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo <> hi").select("doc_id"), "unlike").df
    if unlike.isEmpty():
        return small.withColumn("row", F.lit(0).cast("long"))
    return small.join(unlike.withColumn("several", F.lit(True)), "doc_id", "left").select("doc_id", "text", F.when(F.col("several"), mark).otherwise(F.lit(0)).cast("long").alias("row"))


def repeated_stretches(rows: DataFrame) -> DataFrame:
    """(doc_id, row, start, stop) of bytes that lie in strings of SPAN bytes which start earlier too; stretches may touch.

    rows: doc_id, text, row; see _with_rows. Whole contexts are repeats if their 128-bit cryptographic digests under
    this run's salt are equal; all others are compared byte by byte in suffix arrays.
    """
    small_batches(rows.sparkSession)
    texts = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= SPAN)).select("doc_id", "row", "text")
    whole, contested = _contested(texts)
    contexts, bits = _shard_contexts(contested, texts)
    salt = os.urandom(16)

    def search(shard: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_search_shard(shard, bits, salt))

    found = store(contexts.groupBy("shard").applyInArrow(search, f"{_CUTS_SQL}, range long, run binary"), "repeats").df
    inside = found.where("run is null").select("doc_id", "row", "start", "stop")
    across = found.where("run is not null").select("range", "run").groupBy("range").applyInArrow(_merge_runs, _CUTS_SQL)
    return whole.union(inside).union(across)


def _union_length(spans: list) -> list[tuple[int, int]]:
    """Stretches to maximal ones, in order."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _kept(text: str | None, spans: list | None) -> tuple[bytes, list]:
    raw = text.encode() if text else b""
    cuts = _union_length(spans) if spans else []
    if not cuts:
        return raw, []
    edges = [0, *(x for c in cuts for x in c), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), cuts


def _cuts(rows: DataFrame) -> DataFrame:
    return repeated_stretches(rows).distinct().groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """Remove every byte that a string of 100 bytes covers which also starts earlier, in a smaller doc_id or before.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256. Strings are judged on the input;
    matches never cross documents. Texts under 100 bytes, empty and null ones lose nothing. Rows that repeat a doc_id
    and its text are one document, so each keeps what the document keeps; rows that repeat a doc_id with another text
    are documents of their own, in the order of a hash of their texts. Rows without an id keep all and are compared
    with nothing. Other columns are ignored; an empty table gives an empty one. Salted BLAKE2b digests of 128 bits
    stand for contexts that are equal as a whole, and for windows in the merge; all else is compared by its bytes.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kept, cuts = _kept(text, spans)
                n = len(text.encode()) if text else 0
                rows.append((doc, n, n - len(kept), len(cuts), hashlib.sha256(kept).hexdigest()))
            if rows:
                yield record_batch(_DIGESTS, *zip(*rows, strict=True))

    rows = _with_rows(docs)
    return join_null_safe(rows, _cuts(rows), ["doc_id", "row"], "left").select("doc_id", "text", "cuts").mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their repeated stretches, with all their columns; n_chars follows the text.

    A character of which only a part is removed goes whole. A text that loses all stays as an empty one. Rows with
    null or repeated ids as in dedup_substrings.
    """
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t if not s else _kept(t, s)[0].decode("utf-8", "ignore") for t, s in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            columns = [pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    keys = {"doc_id": unused("cut_doc_id", names), "row": unused("cut_row", names), "cuts": unused("cuts", names)}
    rows = _with_rows(docs)
    cuts = _cuts(rows).withColumnsRenamed(keys)
    several = rows.where("row <> 0").select("doc_id").distinct()
    row = F.lit(0).cast("long")
    if not several.isEmpty():
        own = unused("several", names)
        docs = docs.join(several.withColumn(own, F.lit(True)).withColumnRenamed("doc_id", f"{own}_id"), F.col("doc_id").cast("long") == F.col(f"{own}_id"), "left")
        row = F.when(F.col(own), F.xxhash64(F.col("text").cast("string"))).otherwise(F.lit(0))
    same = (F.col("doc_id").cast("long") == F.col(keys["doc_id"])) & (row == F.col(keys["row"]))
    out = change_rows(docs.join(cuts, same, "left").select(*[F.col(f"`{n}`") for n in names], keys["cuts"]), cut, keys["cuts"])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
