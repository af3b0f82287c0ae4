"""Language identification by a bidirectional gated recurrent network over bytes, trained and run in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_of, change_rows, id_crc, record_batch, small_batches, text_bytes

UNKNOWN = "und"
#: Bounds of the labelled sample that the network is fitted on: documents of each language, and pieces of each.
SAMPLE_DOCS = 400
CROPS = 6
CROP_CHARS = 64
HIDDEN = 8
#: Bytes between two resets of the network's state; every byte of a text lies in one such window.
WINDOW = 128
STEPS = 700
BATCH = 96
#: Documents of the pipeline with a lower pooled probability than this have no language that was learned.
LEAST_SCORE = 0.3
_TOGETHER = 2048
_BLOCK = 2 << 20
_PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _soft(x: np.ndarray) -> np.ndarray:
    """The squashing function x / (1 + |x|): like tanh, at a fraction of its time."""
    return x / (1 + np.abs(x))


@dataclass
class ByteNetwork:
    """Weights for both directions and the output layer; languages in output order.

    table[way][part] has a row for each byte, recur[way][part] is the recurrence; parts are the gate that keeps the
    state, the gate that resets it, and the candidate. They are separate arrays so that all work is on whole ones.
    """

    languages: list[str]
    table: list[list[np.ndarray]]
    recur: list[list[np.ndarray]]
    out: list[np.ndarray]
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 7) -> ByteNetwork:
        rng, h, n = np.random.default_rng(seed), HIDDEN, len(languages)

        def draw(scale: float, *shape: int) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        table = [[draw(0.5, 256, h) for _ in range(3)] for _ in range(2)]
        recur = [[draw(1 / np.sqrt(h), h, h) for _ in range(3)] for _ in range(2)]
        return cls(languages, table, recur, [draw(0.3, h, n) for _ in range(2)], np.zeros(n, np.float32))

    def weights(self) -> list[np.ndarray]:
        return [*self.table[0], *self.table[1], *self.recur[0], *self.recur[1], *self.out, self.bias]

    def _step(self, way: int, chars: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """One position of one direction: gates keep and reset, candidate, its recurrent part, and the new state."""
        (tk, tr, tn), (uk, ur, un) = self.table[way], self.recur[way]
        keep = _soft(np.take(tk, chars, 0) + state @ uk) * 0.5 + 0.5
        reset = _soft(np.take(tr, chars, 0) + state @ ur) * 0.5 + 0.5
        past = state @ un
        new = _soft(np.take(tn, chars, 0) + reset * past)
        return keep, reset, new, past, new + keep * (state - new)

    def states(self, way: int, chars: np.ndarray) -> list[np.ndarray]:
        """States after each position of chars [time, row], seen from the left (0) or the right (1)."""
        state = np.zeros((chars.shape[1], HIDDEN), np.float32)
        out: list[np.ndarray] = [state] * len(chars)
        for t in range(len(chars))[:: -1 if way else 1]:
            out[t] = state = self._step(way, chars[t], state)[-1]
        return out

    def pooled(self, chars: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Sums over the positions inside of each row of the languages' probabilities there."""
        left, total = self.states(0, chars), np.zeros((chars.shape[1], len(self.languages)), np.float32)
        state, ones = np.zeros((chars.shape[1], HIDDEN), np.float32), np.ones((len(self.languages), 1), np.float32)
        for t in range(len(chars) - 1, -1, -1):
            state = self._step(1, chars[t], state)[-1]
            p = np.exp(left[t] @ self.out[0] + state @ self.out[1] + self.bias)  # states are within 1, so this can't overflow
            total += p * (inside[t][:, None] / (p @ ones))
        return total

    def gradients(self, chars: np.ndarray, inside: np.ndarray, label: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Mean cross entropy over all positions inside, and its gradients by backpropagation through time."""
        h, (steps, rows) = HIDDEN, chars.shape
        kept, both = [], []
        for way in (0, 1):
            state, trail, after = np.zeros((rows, h), np.float32), [None] * steps, np.empty((steps, rows, h), np.float32)
            for t in range(steps)[:: -1 if way else 1]:
                keep, reset, new, past, nxt = self._step(way, chars[t], state)
                trail[t] = (state, keep, reset, new, past)
                after[t] = state = nxt
            kept.append(trail)
            both.append(after)
        logits = both[0] @ self.out[0] + both[1] @ self.out[1] + self.bias
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        n = max(1, inside.sum())
        right = p[:, np.arange(rows), label]
        loss = float(-(np.log(right + 1e-9) * inside).sum() / n)
        p[:, np.arange(rows), label] -= 1
        d_logits = p * (inside / n)[:, :, None]
        d_out = [b.reshape(-1, h).T @ d_logits.reshape(-1, p.shape[2]) for b in both]
        tables, recurs = [], []
        for way in (0, 1):
            d_both, (uk, ur, un) = d_logits @ self.out[way].T, self.recur[way]
            d_x, d_recur, d_state = [np.empty((steps, rows, h), np.float32) for _ in range(3)], [np.zeros((h, h), np.float32) for _ in range(3)], np.zeros((rows, h), np.float32)
            for t in range(steps)[:: 1 if way else -1]:
                before, keep, reset, new, past = kept[way][t]
                d = d_both[t] + d_state
                d_new = d * (1 - keep) * (1 - np.abs(new)) ** 2
                d_keep = d * (before - new) * 0.5 * (1 - np.abs(2 * keep - 1)) ** 2
                d_reset = d_new * past * 0.5 * (1 - np.abs(2 * reset - 1)) ** 2
                d_past = d_new * reset
                for k, (x, a) in enumerate(((d_keep, d_keep), (d_reset, d_reset), (d_new, d_past))):
                    d_x[k][t] = x
                    d_recur[k] += before.T @ a
                d_state = d * keep + d_keep @ uk.T + d_reset @ ur.T + d_past @ un.T
            flat = chars.ravel()
            tables += [np.stack([np.bincount(flat, x[:, :, j].ravel(), 256) for j in range(h)], 1).astype(np.float32) for x in d_x]
            recurs += d_recur
        return [*tables, *recurs, *d_out, d_logits.sum((0, 1))], loss


def fit(crops: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 7) -> ByteNetwork:
    """Fit a network on short pieces of labelled text with Adam; now and then a piece goes in capitals."""
    languages = sorted(set(labels))
    net, rng = ByteNetwork.fresh(languages, seed), np.random.default_rng(seed)
    if len(languages) < 2:
        return net
    of = {x: np.array([i for i, y in enumerate(labels) if y == x]) for x in languages}
    loud = [c.decode("utf-8", "ignore").upper().encode() for c in crops]
    first, second = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    for step in range(1, steps + 1):
        which = rng.integers(0, len(languages), BATCH)
        chosen = [int(rng.choice(of[languages[k]])) for k in which]
        rows = [(loud if rng.random() < 0.05 else crops)[i][:CROP_CHARS] for i in chosen]
        chars, inside = _padded(rows, CROP_CHARS)
        grads, _ = net.gradients(chars, inside, which)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * (1 - step / (steps + 1)) ** 0.5
        for w, g, m, v in zip(net.weights(), grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def _padded(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes as [time, row], filled up with spaces, and which positions are inside a row."""
    chars = np.frombuffer(b"".join(r.ljust(width) for r in rows), np.uint8).reshape(-1, width).T.astype(np.intp)
    return chars, (np.arange(width)[:, None] < np.array([len(r) for r in rows])).astype(np.float32)


def learn(docs: DataFrame) -> ByteNetwork:
    """Fit on a bounded sample of the rows that have a language and aren't held out; a hash of the id chooses them.

    The sample has about SAMPLE_DOCS documents of each language, and CROPS pieces of CROP_CHARS characters from
    places all over each text. The number of languages is that of the label's values.
    """
    text = F.col("text").cast("string")
    rows = docs.where((id_crc() % 3 != 1) & F.col("lang").isNotNull() & text.isNotNull() & (F.length(text) > 0)).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), text.alias("text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return ByteNetwork.fresh([])
    spin = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    limit = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1 << 20, int(1.1 * SAMPLE_DOCS / n * (1 << 20)) + 1)))])
    last = F.greatest(F.length("text") - CROP_CHARS, F.lit(0)) + 1
    places = F.transform(F.sequence(F.lit(1), F.lit(CROPS)), lambda i: F.col("text").substr((F.pmod(F.xxhash64("doc_id", i), last) + 1).cast("int"), F.lit(CROP_CHARS)))
    sample = rows.where(spin < limit[F.col("lang")]).select("doc_id", "lang", places.alias("crops")).limit(2 * SAMPLE_DOCS * len(counts))
    found = sorted((r["doc_id"], r["lang"], r["crops"]) for r in sample.collect())
    pairs = [(c.encode(), lang) for _, lang, crops in found for c in dict.fromkeys(crops) if c.strip()]
    return fit([c for c, _ in pairs], [x for _, x in pairs])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def classify(net: ByteNetwork, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and pooled probability of every whole text; UNKNOWN and 0 for a null text or one without a letter."""
    raw, bounds = text_bytes(texts)
    size = np.diff(bounds)
    if not net.languages or not len(raw):
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    windows = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), windows)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = bounds[:-1][doc] + nth * WINDOW
    n_in = np.minimum(WINDOW, bounds[1:][doc] - start)
    sums = np.zeros((len(size), len(net.languages)))
    for at in range(0, len(doc), _TOGETHER):
        place = start[at : at + _TOGETHER, None] + np.arange(WINDOW)
        inside = np.arange(WINDOW) < n_in[at : at + _TOGETHER, None]
        chars = np.where(inside, raw[np.minimum(place, len(raw) - 1)], 32).T.astype(np.intp, order="C")
        pooled = net.pooled(chars, inside.T.astype(np.float32))
        for k in range(pooled.shape[1]):
            sums[:, k] += np.bincount(doc[at : at + _TOGETHER], pooled[:, k], len(size))
    p = sums / np.maximum(1, size)[:, None]
    best = p.argmax(1)
    known = np.array([has_letter(t) for t in texts.to_pylist()], bool)
    return [net.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, np.minimum(1.0, p.max(1)), 0.0)


def identify(docs: DataFrame, learn_from: Callable[[DataFrame], ByteNetwork] = learn) -> DataFrame:
    """Predict the language of every whole text.

    Returns doc_id, held_out (crc32 of the id as text, modulo 3, is 1; false for a null id), lang_pred, score. A null
    text, an empty one and one without a letter get `und` with score 0. Repeated rows get a row each; other columns
    are ignored; without labelled rows all are `und`; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    net = learn_from(docs)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches, "text", _BLOCK):
            names, score = classify(net, block.column("text").combine_chunks())
            yield record_batch(_PREDICTED, block.column("doc_id").combine_chunks(), block.column("held_out").combine_chunks(), names, score)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(id_crc() % 3 == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, learn_from: Callable[[DataFrame], ByteNetwork] = learn) -> DataFrame:
    """The rows whose text has a language that was learned, with all their columns; no row moves."""
    small_batches(docs.sparkSession)
    net = learn_from(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches, "text", _BLOCK):
            names, score = classify(net, block.column("text").combine_chunks().cast(pa.string()))
            stays = [n != UNKNOWN and s >= LEAST_SCORE for n, s in zip(names, score, strict=True)]
            yield from block.filter(pa.array(stays, pa.bool_())).to_batches()

    return change_rows(docs, keep)
