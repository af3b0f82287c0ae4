"""Language-model scores: a log-bilinear model over words in clusters, trained with noise-contrastive estimation.

A word is predicted from the two words before it in two steps, its cluster and then the word in its cluster, each by
a normalised log-bilinear model. Words that are frequent enough have vectors of their own, however many they are up to
MOST_WORDS; all others share a few entries by their last letters, and such an entry's words are told apart by their
smoothed counts. Counts and the training of the model run over all training documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, give_back, id_crc, record_batch, small_batches, spread, store

#: Occurrences from which a word has vectors of its own, and how many words have at most: their vectors are broadcast.
LEAST_COUNT = 40
MOST_WORDS = 1 << 14
SHARED = 40
WIDTH = 16
SMOOTH = 0.1
#: Noise clusters that a batch of tokens shares, and noise words that each token has in its cluster.
NOISE = 32
NOISE_WORDS = 4
RATE = 1.0
#: Tokens that stand still for a row beside those that move it: rows met once in a batch move little.
DAMP = 300
SHARD_BYTES = 8 << 20
_TOGETHER = 1024
_STEP = 2048
#: Exponents within this need no shift: their sums over all entries are far from the ends of single precision.
_SAFE = 60
#: A word's number in its shard stands above its count in one number; so many of these a task packs at once.
_COUNT_BITS = 40
_TOLD = 1 << 20
#: Marks from which the search for a drawn number begins.
_GUIDES = 1 << 16
#: Bytes of text that are split into words at once, and tokens that are scored at once: a worker holds little besides numbers.
_BLOCK = 1 << 20
_SCORED_AT_ONCE = 1 << 18
_COUNTED = pa.schema([("word", pa.binary()), ("shard", pa.int64()), ("at", pa.int32()), ("n", pa.int64()), ("texts", pa.list_(pa.binary()))])
_CELLS = pa.schema([("shard", pa.int64()), ("told", pa.binary())])
#: What the scores need of a shard, and the types that the numbers have there.
_BLOB = ["ids", "some", "held", "bounds", "which", "entry", "c"]
_KINDS = (np.int64, np.uint8, np.uint8, np.int64, np.int32, np.int32, np.int64)
_VALUES = [f"v{i}" for i in range(WIDTH + 1)]
_MADE = pa.schema([*[(c, pa.binary()) for c in _BLOB], ("part", pa.int32()), ("row", pa.int32()), ("w", pa.float32()), *[(c, pa.float32()) for c in _VALUES]])
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SCORED_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (A-Z in lower case), the number of each word of all texts in them, and the texts' n+1 bounds."""
    held = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64) // _BLOCK
    edges = np.concatenate([[0], np.flatnonzero(np.diff(held)) + 1, [len(texts)]]).tolist()
    listed, numbers, sizes = [], [], []
    for at, end in zip(edges, edges[1:]):
        words, which, n = _coded_block(texts.slice(at, end - at))
        listed.append(words)
        numbers.append(which)
        sizes.append(n)
    of_all = pa.chunked_array(listed, pa.large_string()).combine_chunks().dictionary_encode()
    place = of_all.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    first = 0
    for k, words in enumerate(listed):
        numbers[k] = place[first : first + len(words)].take(numbers[k])
        first += len(words)
    return of_all.dictionary.cast(pa.large_binary()), np.concatenate(numbers), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _coded_block(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a few texts, the number of each word in them, and the texts' numbers of words."""
    own = pa.concat_arrays([texts])  # a copy from the first byte on: Arrow 23 lowers large strings of a slice wrongly
    lists = pc.ascii_split_whitespace(pc.ascii_lower(own.fill_null("").cast(pa.large_string())))
    flat = lists.flatten()
    full = np.asarray(pc.not_equal(pc.binary_length(flat), 0))
    bounds = lists.offsets.to_numpy()
    n = np.diff(np.concatenate([[0], np.cumsum(full)])[bounds - bounds[0]])
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), n


def shared_entry(word: bytes) -> int:
    """Which of the shared entries a word without vectors of its own has: by its last two bytes."""
    return zlib.crc32(word[-2:]) % SHARED


def sequences(entries: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of the texts with their ends: entry, entries of the word before and the one before that, and text.

    end: the entry of a text's end; the number after it stands for what is before a text's first word.
    """
    n = np.diff(bounds) + 1
    ends = np.cumsum(n)
    token = np.full(int(n.sum()), end, np.int32)
    inner = np.ones(len(token), bool)
    inner[ends - 1] = False
    token[inner] = entries
    text = np.repeat(np.arange(len(n), dtype=np.int32), n)
    firsts = ends - n
    one, two = np.roll(token, 1), np.roll(token, 2)
    one[firsts] = two[firsts] = two[firsts[n > 1] + 1] = end + 1
    return token, one, two, text


@dataclass
class Vocabulary:
    """Entries: words of their own, then the shared ones, then the end; and their clusters.

    mass: training tokens of each entry; members: entries cluster by cluster; starts: where each cluster begins there.
    """

    words: dict[bytes, int]
    mass: np.ndarray
    cluster: np.ndarray
    members: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, words: list[tuple[bytes, int]], shared: np.ndarray, ends: int) -> Vocabulary:
        """From the words and their counts, the counts of shared entries, and that of ends.

        Entries are dealt by mass to about as many clusters as each has members, the heaviest first: a frequent word
        is a cluster of its own, and no cluster has more than twice the members of an even deal.
        """
        mass = np.concatenate([[n for _, n in words], shared, [ends]]).astype(np.float64)
        order = np.argsort(-mass, kind="stable")
        wanted = int(np.ceil(np.sqrt(len(mass))))
        most, cluster, left, own, size, k = 2 * -(-len(mass) // wanted), np.zeros(len(mass), np.int64), mass.sum() + len(mass), 0.0, 0, 0
        for e in order.tolist():
            if size and (own >= left / max(1, wanted - k) or size >= most):
                left, own, size, k = left - own, 0.0, 0, k + 1
            cluster[e] = k
            own, size = own + mass[e] + 1, size + 1
        members = np.argsort(cluster, kind="stable")
        starts = np.searchsorted(cluster[members], np.arange(k + 2))
        return cls({w: i for i, (w, _) in enumerate(words)}, mass, cluster, members, starts)

    @property
    def end(self) -> int:
        return len(self.mass) - 1

    def entries(self, listed: list[bytes] | pa.Array) -> np.ndarray:
        listed = listed if isinstance(listed, pa.Array) else pa.array(listed, pa.large_binary())
        found = pc.index_in(listed, value_set=pa.array(list(self.words), pa.large_binary()))
        other = np.asarray(found.is_null())
        entry = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        tails = pc.binary_slice(listed.filter(pa.array(other)), -2).dictionary_encode()  # few, and all that shared_entry looks at
        shared = np.array([shared_entry(w) for w in tails.dictionary.to_pylist()], np.int64)
        entry[other] = len(self.words) + shared.take(tails.indices.to_numpy(zero_copy_only=False)) if len(shared) else 0
        return entry


class Trainer:
    """What training needs besides the model: where noise comes from."""

    def __init__(self, v: Vocabulary):
        self.v = v
        smooth = v.mass + 1
        total = np.bincount(v.cluster, smooth)
        self.noise = total / total.sum()
        self.shift = np.log(NOISE * self.noise).astype(np.float32)
        self.drawn = np.cumsum(self.noise)
        self.place = np.argsort(v.members, kind="stable")  # of each entry among the members
        self.inside = smooth / total[v.cluster]
        self.inside_shift = np.log(NOISE_WORDS * self.inside).astype(np.float32)
        self.sums = np.concatenate([[0.0], np.cumsum(self.inside[v.members])])
        self.several = np.diff(v.starts)[v.cluster] > 1
        self.steps = np.append(self.sums, np.inf)
        self.scale = _GUIDES / self.sums[-1]
        self.guide = np.searchsorted(self.sums, np.arange(_GUIDES) / self.scale, "right").astype(np.int32)

    def places(self, at: np.ndarray) -> np.ndarray:
        """np.searchsorted(self.sums, at, "right"), quicker: begun a little before the place, found by a few steps."""
        found = self.guide.take((at * self.scale).astype(np.int64) - 1, mode="clip")
        low = np.flatnonzero(self.steps.take(found) <= at)
        flat, at = found.reshape(-1), at.reshape(-1)
        while len(low):  # those that are there already rest
            nearer = flat.take(low) + 1
            flat[low] = nearer
            low = low[self.steps.take(nearer) <= at.take(low)]
        return found

    def inner_noise(self, token: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """NOISE_WORDS entries of each token's cluster, drawn by their counts."""
        c = self.v.cluster.take(token)
        lo, hi = self.v.starts.take(c), self.v.starts.take(c + 1)
        low = self.sums.take(lo)
        at = low[:, None] + rng.random((len(token), NOISE_WORDS)) * (self.sums.take(hi) - low)[:, None]
        return self.v.members.take(np.minimum(np.maximum(self.places(at) - 1, lo[:, None]), hi[:, None] - 1))


def _order(numbers: np.ndarray) -> np.ndarray:
    """A stable order of numbers; those under 65,536 are sorted as 16 bits, by radix."""
    return np.argsort(numbers.astype(np.uint16) if len(numbers) and numbers.max() < 1 << 16 else numbers, kind="stable")


def _counted(number: np.ndarray, values: np.ndarray, size: int, weight: np.ndarray | None = None) -> np.ndarray:
    """The sums of the values that belong to each number, by column: counting is several times as quick as adding rows up.

    weight: factors of values, a row for each; the values of a row then belong to a row of numbers.
    """
    sums = np.empty((values.shape[1], size), values.dtype)
    if weight is not None:
        number, weight = np.ascontiguousarray(number.reshape(weight.shape).T).ravel(), np.ascontiguousarray(weight.T)
    columns = np.ascontiguousarray(values.T)
    if weight is not None:
        columns = (weight * columns[:, None]).reshape(len(columns), -1)
    for k, column in enumerate(columns.astype(np.float64)):
        sums[k] = np.bincount(number, column, size)
    return sums


def _sums(where: np.ndarray, values: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sums of the values that belong to each, and their number.

    weight: factors of values of which several rows in a run share one; the values are then one for each run.
    """
    met = np.zeros(int(where.max()) + 1, bool)
    met[where] = True
    rows = np.flatnonzero(met)
    number = np.empty(len(met), np.int64)
    number[rows] = np.arange(len(rows))
    number = number.take(where)
    sums = _counted(number, values, len(rows), None if weight is None else weight.reshape(len(values), -1))
    return rows, sums.T, np.bincount(number).astype(np.float32)


def _move(table: np.ndarray, rows: np.ndarray, sums: np.ndarray, n: np.ndarray, rate: float) -> None:
    """Rows move by their own mean, damped: rare rows take part in few tokens. sums is overwritten."""
    sums *= (rate / (n + DAMP))[:, None]
    moved = table.take(rows, axis=0)
    moved += sums
    table[rows] = moved


def _unsure(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)): what is missing to certainty. x is overwritten."""
    np.minimum(x, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class LogBilinear:
    """Vectors and biases of clusters and of entries as targets, vectors of entries as contexts (with one for what is
    before a text), and a matrix for either context place."""

    clusters: np.ndarray
    targets: np.ndarray
    context: np.ndarray
    places: np.ndarray

    @classmethod
    def fresh(cls, t: Trainer, seed: int = 5) -> LogBilinear:
        rng, n, k = np.random.default_rng(seed), len(t.v.mass), len(t.noise)
        bias = [np.log(t.noise), np.log(t.inside)]
        first, second = (np.concatenate([rng.normal(0, 0.1, (len(b), WIDTH)), b[:, None]], 1) for b in bias)
        tables = first, second, rng.normal(0, 0.5, (n + 1, WIDTH)), np.stack([np.eye(WIDTH)] * 2) * 0.5
        return cls(*[x.astype(np.float32) for x in tables])

    def copy(self) -> LogBilinear:
        return LogBilinear(self.clusters.copy(), self.targets.copy(), self.context.copy(), self.places.copy())

    def guess(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """What a context expects, with a 1 behind for the biases."""
        return self.expected(self.context.take(one, axis=0), self.context.take(two, axis=0))

    def expected(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """guess from the vectors of the context."""
        g = np.ones((len(one), WIDTH + 1), np.float32)
        np.add(one @ self.places[0], two @ self.places[1], out=g[:, :WIDTH])
        return g

    def learn(self, token: np.ndarray, one: np.ndarray, two: np.ndarray, t: Trainer, rate: float, rng: np.random.Generator) -> None:
        """A step of noise-contrastive estimation: tell each token's cluster, and the token in it, from drawn ones."""
        seen = self.context.take(one, axis=0), self.context.take(two, axis=0)
        g = self.expected(*seen)
        c = t.v.cluster.take(token)
        drawn = np.minimum(np.searchsorted(t.drawn, rng.random(NOISE), "right"), len(t.drawn) - 1)
        own = self.clusters.take(c, axis=0)
        up = _unsure(np.einsum("ij,ij->i", g, own) - t.shift.take(c))
        others = self.clusters.take(drawn, axis=0)
        against = -others
        against[:, WIDTH] += t.shift.take(drawn)  # g has a 1 there
        down = _unsure(g @ against.T)
        back = up[:, None] * own
        back -= down @ others
        step = _counted(c, g, len(self.clusters), up[:, None])
        which = np.zeros((NOISE, len(self.clusters)), np.float32)
        which[np.arange(NOISE), drawn] = 1
        step -= (g.T @ down) @ which
        met = np.bincount(drawn, minlength=len(self.clusters)) * len(c) + np.bincount(c, minlength=len(self.clusters))
        step *= rate / (met + DAMP).astype(np.float32)
        self.clusters += step.T
        some = np.flatnonzero(t.several.take(token))
        if len(some):
            mine, near = token.take(some), g.take(some, axis=0)
            inner = t.inner_noise(mine, rng)
            own, others = self.targets.take(mine, axis=0), self.targets.take(inner, axis=0)
            up = _unsure(np.einsum("ij,ij->i", near, own) - t.inside_shift.take(mine))
            down = _unsure(t.inside_shift.take(inner) - np.einsum("ij,ikj->ik", near, others))
            own *= up[:, None]
            own -= np.einsum("ik,ikj->ij", down, others)
            own += back.take(some, axis=0)
            back[some] = own
            weight = np.concatenate([up[:, None], -down], 1)
            _move(self.targets, *_sums(np.concatenate([mine[:, None], inner], 1).ravel(), near, weight.ravel()), rate)
        back = np.ascontiguousarray(back[:, :WIDTH])
        before = np.concatenate([p @ back.T for p in self.places], 1)
        for k, vectors in enumerate(seen):
            self.places[k] += rate / len(token) * vectors.T @ back
        _move(self.context, *_sums(np.concatenate([one, two]), before.T), rate)

    def fit(self, batch: tuple[np.ndarray, ...], t: Trainer, rate: float, seed: int) -> None:
        """One pass over tokens in an order that the seed gives, in steps that get smaller."""
        token, one, two = batch[:3]
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(token))
        size = min(_TOGETHER, max(64, len(order) // 256))  # a small shard has many steps too
        for at in range(0, len(order), size):
            some = order[at : at + size]
            self.learn(token[some], one[some], two[some], t, np.float32(rate * (1 - 0.9 * at / len(order))), rng)

    def log10(self, token: np.ndarray, one: np.ndarray, two: np.ndarray, v: Vocabulary) -> np.ndarray:
        """log10 probabilities of entries after their contexts: batched products over all clusters, and over all
        members of the token's cluster, normalise both steps."""
        base = np.int64(len(v.mass) + 1)
        pairs, which = np.unique(one.astype(np.int64) * base + two, return_inverse=True)
        g = np.empty((len(pairs), WIDTH + 1), np.float32)
        total = np.empty(len(pairs), np.float32)
        clusters = self.clusters.astype(np.float32)
        first, reach, longest = clusters.T, _longest(clusters), 0.0
        for at in range(0, len(pairs), _STEP):
            part = self.guess(pairs[at : at + _STEP] // base, pairs[at : at + _STEP] % base).astype(np.float32)
            g[at : at + _STEP] = part
            longest = max(longest, own := _longest(part))
            total[at : at + _STEP] = _log_sum(part @ first, own * reach)
        c = v.cluster[token]
        out = np.empty(len(token), np.float32)
        for at in range(0, len(token), _STEP):
            some = slice(at, at + _STEP)
            out[some] = np.einsum("ij,ij->i", g.take(which[some], axis=0), clusters.take(c[some], axis=0)) - total[which[some]]
        by = _order(c)
        edges = np.searchsorted(c[by], np.arange(len(v.starts)))
        targets = self.targets.astype(np.float32)
        for k in range(len(v.starts) - 1):
            own = v.members[v.starts[k] : v.starts[k + 1]]
            if len(own) > 1:
                table = targets[own].T
                most = longest * _longest(table.T)
                for at in range(edges[k], edges[k + 1], _STEP):
                    some = by[at : min(at + _STEP, edges[k + 1])]
                    part = g.take(which.take(some), axis=0)
                    out[some] += np.einsum("ij,ij->i", part, targets.take(token.take(some), axis=0)) - _log_sum(part @ table, most)
        return out.astype(np.float64) / np.log(10)


def _longest(rows: np.ndarray) -> float:
    """The length of the longest row: products of two rows are no larger than those of their lengths."""
    return float(np.sqrt(np.einsum("ij,ij->i", rows, rows).max(initial=0)))


def _log_sum(x: np.ndarray, most: float = np.inf) -> np.ndarray:
    """Logarithms of the sums of the rows' exponentials; x is overwritten. most: a bound of its entries, if known."""
    if most < _SAFE or len(x) and x.max() < _SAFE and x.min() > -_SAFE:
        return np.log(np.exp(x, out=x) @ np.ones(x.shape[1], x.dtype))
    top = x.max(1)
    x -= top[:, None]
    return top + np.log(np.exp(x, out=x).sum(1))


def _tidy(work: Callable, *given):
    """What the work makes of a shard; the worker then gives back what that took. Workers wait for others and are reused."""
    out = work(*given)
    give_back()
    return out


def _in_order(shard: pa.Table) -> pa.Table:
    """A shard's documents sorted by id and text, so that its words have the same numbers each time."""
    return shard.take(pc.sort_indices(shard, [("doc_id", "ascending"), ("text", "ascending")]))


def _count(shard: pa.Table) -> pa.Table:
    """Distinct words of a shard's documents with their numbers there and their counts in its training documents, and a
    row with the documents: the first five of _BLOB, the words' lengths and the words."""
    shard = _in_order(shard)
    number, ids, held = shard.column("shard")[0].as_py(), shard.column("doc_id").combine_chunks(), np.asarray(shard.column("held_out").combine_chunks())
    words, which, bounds = coded_words(shard.column("text").combine_chunks())
    often = np.argsort(-np.bincount(which, minlength=len(words)), kind="stable")  # small numbers pack well
    rank = np.empty(len(words), np.int32)
    rank[often] = np.arange(len(words))
    words, which = words.take(pa.array(often)), rank.take(which)
    n = _in_training(which, bounds, held, len(words))
    sizes, data = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int32), words.buffers()[2]
    data = np.frombuffer(b"" if data is None else data, np.uint8)[: int(sizes.sum())]
    blob = [ids.fill_null(0).to_numpy(), np.asarray(ids.is_valid()).astype(np.uint8), held.astype(np.uint8), bounds.astype(np.int64), which, sizes, data]
    counted = pa.table([words.cast(pa.binary()), pa.array([number] * len(words), pa.int64()), pa.array(np.arange(len(words), dtype=np.int32)), pa.array(n), pa.nulls(len(words), _COUNTED.field("texts").type)], schema=_COUNTED)
    return pa.concat_tables([counted, pa.Table.from_batches([record_batch(_COUNTED, [None], [number], [None], [None], [[_packed(x) for x in blob]])])])


def _in_training(which: np.ndarray, bounds: np.ndarray, held: np.ndarray, words: int) -> np.ndarray:
    """How often each word is in the documents that aren't held out."""
    return np.bincount(which[np.repeat(~held, np.diff(bounds))], minlength=words)


def _packed(values: np.ndarray) -> bytes:
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(cell: pa.Scalar, kind: type) -> np.ndarray:
    raw = cell.as_py()
    return np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True), kind)


def _pack_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts that shards are told, a cell for a shard: steps from number to number, and counts, byte by byte."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        shard, told = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("shard", "told"))
        order = np.argsort(told, kind="stable")
        order = order[_order(shard[order])]
        shard, told = shard[order], told[order]
        starts = np.nonzero(np.append(True, shard[1:] != shard[:-1]))[0]
        cells = []
        for own in np.split(told, starts[1:]):
            steps = np.diff(own >> _COUNT_BITS, prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T
            counts = (own & ((1 << _COUNT_BITS) - 1)).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5].T
            cells.append(_packed(np.concatenate([steps, counts])))
        return record_batch(_CELLS, shard[starts], cells)

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= _TOLD:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _told(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Words' numbers and counts in a cell of _pack_counts."""
    planes = _unpacked(cell, np.uint8).reshape(9, -1)
    wide = np.concatenate([planes[4:], np.zeros((3, planes.shape[1]), np.uint8)])
    steps, counts = np.ascontiguousarray(planes[:4].T).view("<i4").ravel(), np.ascontiguousarray(wide.T).view("<i8").ravel()
    return np.cumsum(steps, dtype=np.int64), counts


def _average(learned: DataFrame, fresh: LogBilinear) -> LogBilinear:
    """The model whose rows are the means of those that shards have learned, by how often they met them.

    The mean is an aggregate by row; as many rows come to the driver as the model has.
    """
    weight = F.col("w").cast("double")
    means = learned.groupBy("part", "row").agg(*[(F.sum(F.col(c) * weight) / F.sum(weight)).alias(c) for c in _VALUES])
    model = fresh.copy()
    tables = [model.clusters, model.targets, model.context, model.places.reshape(-1, WIDTH)]
    for r in means.collect():
        table = tables[r["part"]]
        table[r["row"]] = r[2 : 2 + table.shape[1]]
    return model


def score_texts(docs: DataFrame) -> DataFrame:
    """Score every whole text with a model of the training documents.

    Returns doc_id, held_out (crc32 of the id as text, modulo 10, is 0; false for a null id), n_tokens, n_known,
    train_tokens, base_score, score. Null and empty texts are their end alone; they count, but teach the network
    nothing. Without training documents no token is known, and base_score is 0. Repeated rows are documents of their
    own; other columns are ignored; an empty table gives an empty one. Documents are dealt to shards of about
    SHARD_BYTES by a hash of id and text and sorted there, so scores don't depend on how the input is cut up. Every
    shard trains from one start on all its training documents, and the rows of their models are averaged. A frequent
    word is one row for each shard, and its total a partial aggregate.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(id_crc() % 10 == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    size, trained = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum((~F.col("held_out")).cast("long")), F.lit(0))).first()
    shards = size // SHARD_BYTES + 1
    blank = F.coalesce(F.col("text") == "", F.lit(True))
    dealt = rows.where(~blank).withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)))
    counted = store(dealt.groupBy("shard").applyInArrow(lambda shard: _tidy(_count, shard), "word binary, shard long, at int, n long, texts array<binary>"), "words")
    free_shuffles(spark)
    summed = store(counted.df.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "totals")
    totals = summed.df
    free_shuffles(spark)
    # a word that no other shard's training documents have is known to its shard
    told = counted.df.join(totals.hint("shuffle_hash"), "word").where("c <> n").select("shard", (F.shiftleft(F.col("at").cast("long"), _COUNT_BITS) + F.col("c")).alias("told"))
    known = store(told.mapInArrow(_pack_counts, "shard long, told binary"), "counts").df
    free_shuffles(spark)
    n_words, v_words = totals.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n_train, v_train = n_words + trained, v_words + (trained > 0)
    top = [(bytes(r["word"]), r["c"]) for r in totals.where(F.col("c") >= LEAST_COUNT).orderBy(F.desc("c"), "word").limit(MOST_WORDS).collect()]
    # counts and number of the words that share an entry, by the same rule as shared_entry
    shared = F.pmod(F.crc32(F.expr("substring(word, greatest(length(word) - 1, 1), 2)")), F.lit(SHARED)).cast("int")
    mass, kinds = np.zeros(SHARED), np.zeros(SHARED)
    for part, c, k in totals.where("c > 0").groupBy(shared.alias("part")).agg(F.sum("c"), F.count(F.lit(1))).collect():
        mass[part], kinds[part] = c, k
    for word, c in top:
        part = shared_entry(word)
        mass[part], kinds[part] = mass[part] - c, kinds[part] - 1
    summed.drop()
    free_shuffles(spark)
    vocabulary = Vocabulary.of(top, mass, trained)
    trainer = Trainer(vocabulary)
    fresh = LogBilinear.fresh(trainer)
    start = spark.sparkContext.broadcast((trainer, fresh))

    def train(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return _MADE.empty_table()
        t, begun = start.value
        *given, sizes, data = left.column("texts")[0].values
        _, _, held, bounds, which = (_unpacked(cell, kind) for cell, kind in zip(given, _KINDS))
        held, offsets = held.astype(bool), np.concatenate([[0], np.cumsum(_unpacked(sizes, np.int32), dtype=np.int64)])
        words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(_unpacked(data, np.uint8))])
        entry, c = t.v.entries(words).astype(np.int32), _in_training(which, bounds, held, len(words))
        for cell in right.column("told"):
            at, n = _told(cell)
            c[at] = n
        batches = [record_batch(_MADE, *[[cell.as_py()] for cell in given], [_packed(entry)], [_packed(c)], *[[None]] * (3 + len(_VALUES)))]
        del left, right, given, data, words, offsets, c
        kept = np.nonzero(~held)[0]
        n = np.diff(bounds)
        if len(kept):
            inner = np.repeat(~held, n)
            batch = sequences(entry.take(which[inner]), np.concatenate([[0], np.cumsum(n[kept])]), t.v.end)[:3]
            del which, inner
            mine = begun.copy()
            mine.fit(batch, t, RATE, int(len(batch[0])))
            token, one, two = batch
            seen = [np.bincount(t.v.cluster[token], minlength=len(mine.clusters)), np.bincount(token, minlength=len(mine.targets)), np.bincount(one, minlength=len(mine.context)) + np.bincount(two, minlength=len(mine.context)), np.full(2 * WIDTH, len(token))]
            for part, (table, w) in enumerate(zip((mine.clusters, mine.targets, mine.context, mine.places.reshape(-1, WIDTH)), seen, strict=True)):
                some = np.nonzero(w)[0]
                values = [table[some, i] if i < table.shape[1] else np.zeros(len(some), np.float32) for i in range(WIDTH + 1)]
                batches.append(record_batch(_MADE, *[[None] * len(some)] * len(_BLOB), np.full(len(some), part), some, w[some].astype(np.float32), *values))
        return pa.Table.from_batches(batches)

    schema = ", ".join([*[f"{c} binary" for c in _BLOB], "part int, row int, w float", *[f"{c} float" for c in _VALUES]])
    texts, parts = counted.df.where("texts is not null").select("shard", "texts"), max(1, min(shards, spread(spark)))
    made = store(texts.repartition(parts, "shard").groupBy("shard").cogroup(known.repartition(parts, "shard").groupBy("shard")).applyInArrow(lambda left, right: _tidy(train, left, right), schema), "trained").df
    counted.drop()
    free_shuffles(spark)
    model = _average(made.where("part is not null").select("part", "row", "w", *_VALUES), fresh)
    inner = np.zeros(len(vocabulary.mass))
    inner[len(top) : len(top) + SHARED] = np.log10(SMOOTH * (kinds + 1) + mass)
    scale = np.log10(n_train + SMOOTH * (v_train + 1)) if n_train else np.log10(SMOOTH)
    values = spark.sparkContext.broadcast((model, vocabulary, inner))

    def score_shard(cells: list[pa.Scalar]) -> pa.RecordBatch:
        net, v, within = values.value
        ids, some, held, bounds, which, entry, c = (_unpacked(cell, kind) for cell, kind in zip(cells, _KINDS, strict=True))
        word, one, two, doc = sequences(which, bounds, len(entry))  # words by their numbers in the shard, as contexts too
        entry, c = np.append(entry, [v.end, v.end + 1]).astype(np.int32), np.append(c, trained)
        own = np.log10(c + SMOOTH)
        share = (entry[:-1] >= len(v.words)) & (entry[:-1] < v.end)
        inside = np.where(share, own - within.take(entry[:-1]), 0.0)
        own, met = own - scale, (c > 0).astype(np.float64)
        base, known, found = (np.zeros(len(ids)) for _ in range(3))
        for at in range(0, len(word), _SCORED_AT_ONCE):
            w, before, first, d = (x[at : at + _SCORED_AT_ONCE] for x in (word, one, two, doc))
            told = net.log10(entry.take(w), entry.take(before), entry.take(first), v)
            for total, parts in ((base, own.take(w)), (known, met.take(w)), (found, told + inside.take(w))):
                total += np.bincount(d, parts, len(ids))
        return record_batch(_SCORED, pa.array(ids, mask=some == 0), held.astype(bool), np.diff(bounds) + 1, known.astype(np.int64), np.full(len(ids), n_train), base, found)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield _tidy(score_shard, [column[i] for column in batch.columns])

    full = made.where("ids is not null").select(*_BLOB).mapInArrow(score, _SCORED_SQL)
    token, one, two, _ = sequences(np.zeros(0, np.int64), np.zeros(2, np.int64), vocabulary.end)
    alone = [F.lit(1).cast("long").alias("n_tokens"), F.lit(int(trained > 0)).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), F.lit(float(np.log10(trained + SMOOTH) - scale)).alias("base_score"), F.lit(float(model.log10(token, one, two, vocabulary)[0])).alias("score")]
    return full.union(rows.where(blank).select("doc_id", "held_out", *alone))
