"""Workers must not hold much more than their texts."""

import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa

from larkspur.llm import lm_score, packing
from larkspur.llm.common import blocks_of
from larkspur.llm.lm_score import LogBilinear, Trainer, Vocabulary, coded_words, sequences
from larkspur.llm.tokens import WordIds, tokenizer_path


def test_packing_finds_ids_of_little_text_at_once():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, 2000)) for _ in range(1000)]
    batches = [pa.RecordBatch.from_pydict({"text": texts[a : a + 50]}) for a in range(0, 1000, 50)]
    words = WordIds(tokenizer_path())
    tracemalloc.start()
    for block in blocks_of(iter(batches), "text", packing._BLOCK):
        words.texts(block.column("text").combine_chunks())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20


def test_words_of_a_shard_take_little_besides_their_numbers():
    """Texts are split block by block: their words are never all held with their offsets."""
    code = """
import numpy as np, pyarrow as pa
from larkspur.llm.lm_score import coded_words
rng = np.random.default_rng(3)
texts = pa.array([" ".join(f"w{x} É" for x in rng.integers(0, 3000, 2000)) for _ in range(1000)])
words, which, bounds = coded_words(texts)
assert len(words) == 3001 and bounds[-1] == len(which) == 4_000_000
print(pa.default_memory_pool().max_memory() / texts.nbytes)
"""
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2], timeout=120)
    assert float(run.stdout) < 2.5


def test_words_of_blocks_and_slices_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [None if i % 50 == 7 else " " * (i % 3) + " ".join(f"É{x}A" for x in rng.integers(0, 300, i % 90)) for i in range(400)]
    whole = coded_words(pa.array(texts, pa.string()))
    assert whole[0].to_pylist() == list(dict.fromkeys(w for t in texts if t for w in t.encode().lower().split()))
    for block in (1, 100, 5000):
        monkeypatch.setattr(lm_score, "_BLOCK", block)
        words, which, bounds = coded_words(pa.array(["x", *texts, "y"], pa.string()).slice(1, 400))
        assert words == whole[0] and (which == whole[1]).all() and (bounds == whole[2]).all()


def test_scores_of_some_tokens_at_once_are_those_of_all():
    rng = np.random.default_rng(5)
    v = Vocabulary.of([(b"w%d" % i, 5000 - i) for i in range(3000)], np.arange(40) * 3.0, 500)
    model = LogBilinear.fresh(Trainer(v))
    token, one, two, _ = sequences(rng.integers(0, v.end, 20_000), np.arange(0, 20_001, 100), v.end)
    whole = model.log10(token, one, two, v)
    parts = np.concatenate([model.log10(token[a : a + 777], one[a : a + 777], two[a : a + 777], v) for a in range(0, len(token), 777)])
    assert np.abs(whole - parts).max() < 1e-5
    listed = [b"w7", b"", b"q", b"zz", b"long word", b"w2999", b"w3000"]
    assert v.entries(listed).tolist() == [v.words.get(w, 3000 + lm_score.shared_entry(w)) for w in listed]


def test_documents_of_a_shard_are_kept_whole_beside_its_words():
    """The row with a shard's documents gives the words, in their order, that the texts have; white space has none."""
    texts = ["b a a", "É b\tB", " ", "a", "c c c c c"]
    ids, held = [3, None, 4, 5, 6], [False, False, True, True, False]
    shard = pa.table({"shard": pa.array([9] * 5, pa.int64()), "doc_id": pa.array(ids, pa.int64()), "held_out": held, "text": texts})
    for some in (shard, shard.slice(2, 1)):
        out = lm_score._count(some.combine_chunks())
        listed, last = out.slice(0, len(out) - 1).to_pylist(), out.slice(len(out) - 1)
        assert [r["at"] for r in listed] == list(range(len(listed))) and all(r["texts"] is None for r in listed) and last["word"].to_pylist() == [None]
        cells = list(last.combine_chunks()["texts"][0].values)
        known, valid, out_held, bounds, which, sizes, data = (lm_score._unpacked(c, k) for c, k in zip(cells, (*lm_score._KINDS[:5], np.int32, np.uint8)))
        ends = np.cumsum(sizes)
        words = [bytes(data[e - n : e]) for e, n in zip(ends, sizes)]
        assert words == [r["word"] for r in listed]
        found = {int(i) if v else None: (bool(h), [words[w] for w in which[a:b]]) for i, v, h, a, b in zip(known, valid, out_held, bounds, bounds[1:])}
        own = {r["doc_id"]: (r["held_out"], r["text"].encode().lower().split()) for r in some.to_pylist()}
        assert found == own
        train = [w for h, t in own.values() if not h for w in t]
        assert all(r["n"] == train.count(r["word"]) for r in listed)
