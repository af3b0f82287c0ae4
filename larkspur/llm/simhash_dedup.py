"""SimHash near-duplicates by an inverted index over positional bytes with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.shared import join_null_safe, unused

from .common import Stored, ascii_words, record_batch, small_batches, store
from .components import connected_components

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
#: Fingerprints that differ in at most MAX_BITS bits differ in at most as many of their 8 bytes.
LEAST_EQUAL_BYTES = 8 - MAX_BITS
_STEP = 1 << 16
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64()), ("row", pa.int64())])


def index_positions(fingerprints: int) -> list[tuple[int, ...]]:
    """Sets of byte positions of which every five positions include one: three, four or five positions each.

    More positions make postings shorter and more numerous, so the size goes by the number of fingerprints; which
    pairs are found doesn't depend on it. Of any five of eight positions three lie in one half.
    """
    if fingerprints <= 1 << 24:
        return [t for half in (range(0, 4), range(4, 8)) for t in combinations(half, 3)]
    whole = list(combinations(range(8), LEAST_EQUAL_BYTES))
    if fingerprints > 1 << 32:
        return whole
    chosen: list[tuple[int, ...]] = []
    while missing := [set(w) for w in whole if not any(set(c) <= set(w) for c in chosen)]:
        chosen.append(max(combinations(range(8), 4), key=lambda c: sum(set(c) <= w for w in missing)))
    return chosen


def fingerprint_of(text: str | None) -> int:
    """The 64-bit SimHash of a whole text; 0 for one without words."""
    words = ascii_words(text)
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE_WORDS:
        return digest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - SHINGLE_WORDS + 1].tolist()
    ends = ends[SHINGLE_WORDS - 1 :].tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STEP):
        part = hashes[at : at + _STEP].astype("<u8").view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.array([fingerprint_of(t) for t in batch.column(1).to_pylist()], np.uint64)
        yield record_batch(_SCHEMA, batch.column(0), marks.view(np.int64), batch.column(2))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, row) of every row; the long fingerprint has its 64 bits, row is a hash of all columns."""
    small_batches(docs.sparkSession)
    columns = [F.col(f"`{f.name}`") if not isinstance(f.dataType, T.MapType) else F.to_json(F.col(f"`{f.name}`")) for f in docs.schema.fields]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(*columns).alias("row"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fingerprint long, row long")


def _mask(positions: tuple[int, ...]) -> int:
    value = sum(255 << (8 * p) for p in positions)
    return value - (1 << 64) if value >= 1 << 63 else value


def _equal_bytes(a: Column, b: Column) -> Column:
    differ = a.bitwiseXOR(b)
    return sum((F.shiftrightunsigned(differ, 8 * i).bitwiseAND(F.lit(255)) == 0).cast("int") for i in range(8))


def _close(a: Column, b: Column) -> Column:
    """The equal positional bytes of a pair are tallied, and only pairs with the guaranteed five go to the bit count."""
    return (_equal_bytes(a, b) >= LEAST_EQUAL_BYTES) & (F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS)


def _postings(marks: DataFrame, positions: list[tuple[int, ...]], *more: str) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(i).alias("entry"), F.col("fingerprint").bitwiseAND(F.lit(_mask(p))).alias("value")) for i, p in enumerate(positions)])
    return marks.select("fingerprint", *more, F.explode(entries).alias("e")).select("e.entry", "e.value", "fingerprint", *more)


def linked_fingerprints(marks: DataFrame) -> Stored:
    """(node, component) of distinct fingerprints that reach others over links of MAX_BITS or fewer bits.

    The postings list of an index entry holds the fingerprints that agree in the entry's positions. First each is
    compared with the smallest of its list, which joins most of a dense group at once. Then lists that hold several of
    the groups so made are searched again: all that isn't in a list's largest group meets the whole list. So a list of
    one group of near copies emits nothing, and no link between two groups is missed.
    """
    count = marks.agg(F.count(F.lit(1))).first()[0]
    positions = index_positions(count)
    postings = _postings(marks, positions)
    heads = postings.groupBy("entry", "value").agg(F.min("fingerprint").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = postings.join(heads, ["entry", "value"]).where((F.col("fingerprint") > F.col("head")) & _close(F.col("fingerprint"), F.col("head"))).select(F.col("fingerprint").alias("a"), F.col("head").alias("b"))
    first = connected_components(stars)
    grouped = store(marks.join(first.df, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", F.coalesce("component", "fingerprint").alias("group")), "groups")
    lists = _postings(grouped.df, positions, "group")
    sizes = lists.groupBy("entry", "value", "group").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("entry", "value").agg(F.max(F.struct("n", "group")).alias("top"), F.count(F.lit(1)).alias("groups")).where("groups > 1").select("entry", "value", F.col("top.group").alias("main"))
    mixed = store(lists.join(mixed, ["entry", "value"]), "mixed")
    x, y = mixed.df.where(F.col("group") != F.col("main")).alias("x"), mixed.df.alias("y")
    on = (F.col("x.entry") == F.col("y.entry")) & (F.col("x.value") == F.col("y.value")) & (F.col("x.group") != F.col("y.group")) & _close(F.col("x.fingerprint"), F.col("y.fingerprint"))
    across = x.join(y, on).select(F.col("x.group").alias("a"), F.col("y.group").alias("b")).distinct()
    second = connected_components(across)
    joined = grouped.df.join(second.df, F.col("group") == F.col("node"), "left").select(F.col("fingerprint").alias("node"), F.coalesce("component", "group").alias("component"))
    made = store(joined, "linked")
    for done in (first, second, grouped, mixed):
        done.drop()
    return made


def _named(own: DataFrame) -> Stored:
    """(fingerprint, component, component_id): the smallest doc_id that can be reached; null if no row there has one."""
    marks = store(own.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "marks")
    linked = linked_fingerprints(marks.df.select("fingerprint"))
    told = marks.df.join(linked.df, F.col("fingerprint") == F.col("node")).select("fingerprint", "least", "component")
    least = told.groupBy("component").agg(F.min("least").alias("component_id"))
    # stored, so that the join with all rows has an exchange of its own on either side and a hot fingerprint can be split
    made = store(told.join(least, "component").select("fingerprint", "component", "component_id"), "named")
    marks.drop()
    linked.drop()
    return made


def simhash_groups(docs: DataFrame) -> DataFrame:
    """Group documents whose SimHash fingerprints can be reached over links of 3 or fewer differing bits.

    Returns doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id of the group. Texts that are null
    or hold no word have the fingerprint zero and are linked like any other. Equal fingerprints collapse to one row
    before pairs are formed; a repeated doc_id gives a row each time; rows without a doc_id are linked by their texts
    too, and a group of such rows alone has no component_id; columns beyond doc_id and text are ignored. An empty
    table gives an empty one.
    """
    own: Stored = store(fingerprints(docs).select("doc_id", "fingerprint"), "fingerprints")
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return own.df.join(_named(own.df).df, "fingerprint").select("doc_id", hexed.alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each SimHash group, with all its columns: the one with the smallest doc_id.

    Rows without an id come after all others; of rows with one id the one with the smallest hash of its columns stays,
    and of rows that are alike in all columns one. So every group keeps exactly one row, whatever its ids.
    """
    own = store(fingerprints(docs), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")
    best = own.df.join(_named(own.df).df.select("fingerprint", "component"), "fingerprint").groupBy("component").agg(F.min(order).alias("best"))
    kept = store(best.select(F.col("best.doc_id").alias("doc_id"), F.col("best.row").alias("row")), "kept")
    twice = join_null_safe(own.df.groupBy("doc_id", "row").count().where("count > 1"), kept.df, ["doc_id", "row"], "left_semi")
    names = docs.columns
    mark = unused("_row", names)
    columns = [F.col(f"`{f.name}`") if not isinstance(f.dataType, T.MapType) else F.to_json(F.col(f"`{f.name}`")) for f in docs.schema.fields]
    told = docs.withColumn(mark, F.xxhash64(*columns))
    here = kept.df.withColumnsRenamed({"doc_id": f"{mark}_id", "row": f"{mark}_own"})
    stays = told.join(here, F.col("doc_id").cast("long").eqNullSafe(F.col(f"{mark}_id")) & (F.col(mark) == F.col(f"{mark}_own")), "left_semi")
    alone = stays if twice.isEmpty() else stays.dropDuplicates([f.name for f in told.schema.fields if not isinstance(f.dataType, T.MapType)])
    return alone.drop(mark)
