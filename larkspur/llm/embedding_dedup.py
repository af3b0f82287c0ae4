"""Near-duplicate embeddings: codes by iterative quantisation, multi-index Hamming tables, exact cosines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, record_batch, small_batches, store
from .components import connected_components

COSINE = 0.9
#: Distinct vectors of a length on which its rotations are fitted, at most; a hash of the id chooses them.
SAMPLE = 8192
ROUNDS = 15
#: Bits of all rotations together, from which tables draw theirs, and of the code by which candidates are sifted.
POOL_BITS = 1024
CODE_BITS = 256
_WORDS = CODE_BITS // 64
#: Share of pairs at the cosine asked that some table brings together, as measured on made-up pairs.
REACH = 0.98
#: Bits of a table's key beyond log2 of the number of vectors: unrelated vectors meet in one table of four.
SPARE_BITS = 2
#: Where unrelated vectors have this cosine on average, all but all of them link, and centring leaves only noise.
ALL_ALIKE = 0.85
BLOCK = 1024
#: Rows that a call of the exact comparison gets, about.
CALL_ROWS = 20_000
_CODED = pa.schema([("cls", pa.int64()), ("code", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])
_LINKED = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Codes:
    """Mean and projection to POOL_BITS signs, the bits of each table, and bounds on the bits in which codes differ.

    near: what vectors at the cosine of COSINE differ in on average; most: what hardly any of them exceeds.
    """

    mean: np.ndarray
    projection: np.ndarray
    tables: np.ndarray
    near: int
    most: int

    def signs(self, vectors: np.ndarray) -> np.ndarray:
        return (unit_rows(vectors) - self.mean) @ self.projection >= 0

    def keys(self, signs: np.ndarray) -> np.ndarray:
        """A number for each table and vector: the table's bits of the vector, and the table's number above them."""
        bits = self.tables.shape[1]
        weights = 1 << np.arange(bits, dtype=np.int64)
        out = np.empty((len(signs), len(self.tables)), np.int64)
        for t, chosen in enumerate(self.tables):
            out[:, t] = signs[:, chosen] @ weights
        return out + (np.arange(len(self.tables), dtype=np.int64) << bits)

    def codes(self, signs: np.ndarray) -> np.ndarray:
        return np.packbits(signs[:, :CODE_BITS], axis=1, bitorder="little").view("<i8")


def _rotations(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rotations by iterative quantisation side by side, until there are POOL_BITS columns.

    Each starts at random; then the signs for the rotation at hand, and the rotation that fits the signs best, in turn.
    """
    parts, n = [], v.shape[1]
    for _ in range(-(-POOL_BITS // n)):
        turn, _ = np.linalg.qr(rng.normal(size=(n, n)))
        for _ in range(ROUNDS):
            left, _, right = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (left @ right).T
        parts.append(turn)
    return np.concatenate(parts, 1)[:, :POOL_BITS]


def _made_up_pairs(x: np.ndarray, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors with partners at the cosine of COSINE: in a direction of its own, and towards other vectors."""
    out = []
    for other in (rng.normal(size=x.shape), x[rng.permutation(len(x))]):
        aside = other - (other * x).sum(1, keepdims=True) * x
        size = np.linalg.norm(aside, axis=1)
        ok = size > 1e-6
        if ok.any():
            out.append((x[ok], COSINE * x[ok] + np.sqrt(1 - COSINE**2) * aside[ok] / size[ok, None]))
    return out


def learn_codes(vectors: np.ndarray, count: int, seed: int = 11) -> Codes:
    """Fit rotations on a sample of vectors, and choose tables for count vectors.

    A table's key has log2(count) + SPARE_BITS bits, so that buckets don't grow with the data. There are as many tables
    as bring REACH of made-up pairs together: vectors of the sample with partners at the cosine asked.
    """
    x, rng = unit_rows(vectors), np.random.default_rng(seed)
    mean = x.mean(0)
    if mean @ mean > ALL_ALIKE:
        mean = np.zeros_like(mean)
    v = x - mean
    _, axes = np.linalg.eigh(np.atleast_2d(np.cov(v.T)) if len(x) > 1 else np.eye(x.shape[1]))
    projection = axes @ _rotations(v @ axes, rng)
    bits = min(40, max(8, int(count - 1).bit_length() + SPARE_BITS))
    pairs = _made_up_pairs(x[: max(1, SAMPLE // 4)], rng)
    differ = [((a - mean) @ projection >= 0) ^ ((b - mean) @ projection >= 0) for a, b in pairs] or [np.zeros((1, POOL_BITS), bool)]
    spread = [d[:, :CODE_BITS].sum(1) for d in differ]
    tables, missed = [], [np.ones(len(d), bool) for d in differ]
    while len(tables) < 1 << 12 and max(m.mean() for m in missed) > 1 - REACH:
        chosen = rng.choice(POOL_BITS, bits, replace=False)
        tables.append(chosen)
        missed = [m & d[:, chosen].any(1) for m, d in zip(missed, differ, strict=True)]
    near = max(float(s.mean()) for s in spread)
    most = max(float(np.quantile(s, 0.9995)) for s in spread)
    return Codes(mean, projection, np.array(tables or [np.arange(bits)]), int(np.ceil(near)), int(np.ceil(most)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _distance(x: str, y: str) -> Column:
    """The bits in which two codes differ."""
    parts = [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(_WORDS)]
    return reduce(lambda a, b: a + b, parts)


def _grouped(codes: DataFrame, bounds: Codes) -> tuple[DataFrame, DataFrame]:
    """(groups, pairs): group and radius of each vector's group, and pairs of groups that may hold links.

    In each bucket of a table every vector meets the smallest id; the smallest one whose code is near becomes its
    group. So a dense part of the data is a few groups with one middle each, and only groups go on: two that share a
    bucket are a pair if their middles are no farther apart than their radii and a link allow.
    """
    rows = codes.select("cls", F.explode("keys").alias("key"))
    heads = rows.groupBy("key").agg(F.min("cls").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = rows.join(heads, "key").where("cls > head").select("cls", "head").distinct()
    plain = codes.select("cls", "code")
    close = met.join(plain, "cls").join(plain.select(F.col("cls").alias("head"), F.col("code").alias("middle")), "head").withColumn("away", _distance("code", "middle")).where(F.col("away") <= bounds.near)
    own = close.groupBy("cls").agg(F.min(F.struct("head", "away")).alias("best")).select("cls", F.col("best.head").alias("group"), F.col("best.away").alias("away"))
    grouped = store(codes.join(own, "cls", "left").select("cls", "code", "keys", F.coalesce("group", "cls").alias("group"), F.coalesce("away", F.lit(0)).alias("away")), "groups").df
    middles = grouped.groupBy("group").agg(F.max("away").alias("radius")).join(plain.withColumnRenamed("cls", "group"), "group")
    entries = grouped.select("group", F.explode("keys").alias("key")).distinct()
    x, y = entries.alias("x"), entries.alias("y")
    several = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    shared = store(entries.join(several, "key"), "buckets").df
    x, y = shared.alias("x"), shared.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.group") < F.col("y.group"))).select(F.col("x.group").alias("lo"), F.col("y.group").alias("hi")).distinct()
    sides = [middles.select(F.col("group").alias(s), F.col("code").alias(f"{s}_code"), F.col("radius").alias(f"{s}_radius")) for s in ("lo", "hi")]
    sifted = pairs.join(sides[0], "lo").join(sides[1], "hi").where(_distance("lo_code", "hi_code") <= bounds.most + F.col("lo_radius") + F.col("hi_radius"))
    return grouped.select("cls", "group"), store(sifted.select("lo", "hi"), "pairs").df


def _reach(links: np.ndarray) -> np.ndarray:
    """For each node of a link matrix the first node that can be reached from it."""
    out = np.full(len(links), -1)
    for i in range(len(links)):
        if out[i] < 0:
            seen = front = np.arange(len(links)) == i
            while front.any():
                near = links[front].any(0) & ~seen
                seen, front = seen | near, near
            out[seen] = i
    return out


def _compare(table: pa.Table) -> pa.Table:
    """Exact cosines in units, each a block of a group against itself or against another block.

    Gives, for every vector, the weight of those that it links to in a unit, and the first that it reaches there.
    """
    names = ("lo", "hi", "i", "j", "side", "cls", "m")
    column = {c: table.column(c).to_numpy() for c in names}
    order = np.lexsort([column[c] for c in ("cls", "side", "j", "i", "hi", "lo")])
    lo, hi, i, j, side, cls, m = (column[c][order] for c in names)
    vectors = table.column("embedding").combine_chunks().take(pa.array(order))
    new = np.ones(len(lo), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in (lo, hi, i, j)], axis=0)
    starts = np.append(np.nonzero(new)[0], len(lo))
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a < 2:
            continue
        own = vectors.slice(a, b - a)
        x = unit_rows(own.flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1))
        near = x @ x.T >= COSINE
        np.fill_diagonal(near, False)
        if lo[a] != hi[a] or i[a] != j[a]:  # two blocks: pairs inside either are counted where it meets itself
            near &= side[a:b, None] != side[None, a:b]
        some = near.any(0)
        if some.any():
            out.append(np.stack([cls[a:b], near @ m[a:b], cls[a:b][_reach(near)]])[:, some])
    both = np.concatenate(out, 1) if out else np.zeros((3, 0), np.int64)
    return pa.table([pa.array(c, pa.int64()) for c in both], schema=_LINKED)


def _usable() -> Column:
    e = F.col("embedding")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~bad & F.exists(e, lambda v: v != 0), F.lit(False))


def _candidates(classes: DataFrame, dim: int, count: int) -> tuple[DataFrame, DataFrame]:
    """Groups and pairs of groups among the distinct vectors of one length."""
    sample = classes.orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select("embedding").toArrow()
    learned = learn_codes(_matrix(sample.column(0).combine_chunks(), dim), count)
    shared = classes.sparkSession.sparkContext.broadcast(learned)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                signs = shared.value.signs(_matrix(batch.column(1), dim))
                yield record_batch(_CODED, batch.column(0), list(shared.value.codes(signs)), list(shared.value.keys(signs)))

    codes = store(classes.select("cls", "embedding").mapInArrow(encode, "cls long, code array<long>, keys array<long>"), "codes").df
    return _grouped(codes, learned)


def _links(classes: DataFrame) -> tuple[DataFrame, Stored]:
    """(cls, n) with the links of each distinct vector to other ones, and the components over these links.

    classes: dim, cls, m (copies), embedding. Vectors of a length that few have are one group; those of other lengths
    get groups by codes. Every group is compared with itself and with those that it may share links with, by blocks.
    """
    lengths = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    few = [d for d, n in lengths.items() if n <= BLOCK]
    small = classes.where(F.col("dim").isin(few))
    least = small.groupBy("dim").agg(F.min("cls").alias("group"))
    groups = small.join(least, "dim").select("cls", "group")
    pairs = None
    for dim, n in sorted(lengths.items()):
        if n > BLOCK:
            own, more = _candidates(classes.where(F.col("dim") == dim), dim, n)
            groups, pairs = groups.unionByName(own), more if pairs is None else pairs.unionByName(more)
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    inside = sizes.where("size > 1").select(F.col("group").alias("lo"), F.col("group").alias("hi"))
    units = inside if pairs is None else inside.unionByName(pairs)
    blocks = sizes.select("group", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    units = store(units.join(blocks.withColumnsRenamed({"group": "lo", "blocks": "lo_blocks"}), "lo").join(blocks.withColumnsRenamed({"group": "hi", "blocks": "hi_blocks"}), "hi"), "units").df
    # only vectors of groups that meet something go on
    wanted = units.select(F.col("lo").alias("group")).union(units.select("hi")).distinct()
    members = store(groups.join(wanted, "group").join(blocks, "group").join(classes.select("cls", "m", "embedding"), "cls").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).drop("blocks"), "members").df
    ranges = F.sequence(F.lit(0), F.col("hi_blocks") - 1)
    left = members.join(units.withColumnRenamed("lo", "group"), "group").select(F.col("group").alias("lo"), "hi", F.col("block").alias("i"), F.explode(ranges).alias("j"), F.lit(0).alias("side"), "cls", "m", "embedding").where("lo <> hi or i <= j")
    right = members.join(units.withColumnRenamed("hi", "group"), "group").select("lo", F.col("group").alias("hi"), F.explode(F.sequence(F.lit(0), F.col("lo_blocks") - 1)).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "cls", "m", "embedding").where("lo <> hi or i < j")
    met = left.union(right)
    rows = units.join(sizes.withColumnsRenamed({"group": "lo", "size": "a"}), "lo").join(sizes.withColumnsRenamed({"group": "hi", "size": "b"}), "hi").agg(F.coalesce(F.sum(F.col("a") * F.col("hi_blocks") + F.col("b") * F.col("lo_blocks")), F.lit(0))).first()[0]
    call = F.pmod(F.xxhash64("lo", "hi", "i", "j"), F.lit(rows // CALL_ROWS + 1))
    found = store(met.withColumn("call", call).groupBy("call").applyInArrow(_compare, "cls long, n long, root long"), "cosines").df
    return found.groupBy("cls").agg(F.sum("n").alias("n")), connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))


def embedding_groups(vectors: DataFrame) -> DataFrame:
    """Link vectors with a cosine of 0.9 or more and group what can be reached.

    Returns vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept. Vectors of
    every length are compared, with those of their own length. Equal vectors collapse to one before anything is
    compared, and their copies are counted. Candidates come from tables of a code's bits, whose number and size follow
    from the data; groups of candidates are compared by exact cosines in blocks, from which only counts and a spanning
    forest leave. Null, empty and zero vectors, those with a null or non-finite component, and rows without an id link
    with nothing and stay. Repeated rows are copies of each other; other columns are ignored; an empty table gives an
    empty one.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = _usable()
    good = rows.where(usable)
    classes = store(good.groupBy("embedding").agg(F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("m")).withColumn("dim", F.size("embedding")), "classes").df
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if classes.isEmpty():
        return alone
    counts, parts = _links(classes)
    told = classes.select("embedding", "cls", "m").join(counts, "cls", "left").join(parts.df, F.col("cls") == F.col("node"), "left")
    told = told.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    linked = good.join(told, "embedding").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.union(alone)
