"""Tokens, words, networks and trees: what needs no Spark."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import html_extract as H
from larkspur.llm.common import ascii_words
from larkspur.llm.decontaminate import Matcher, align, align_all, words_of
from larkspur.llm.language_id import UNKNOWN, ByteNetwork, _padded, classify, fit
from larkspur.llm.license_scan import KNOWN, canonical_text, catalogue
from larkspur.llm import lm_score
from larkspur.llm.lm_score import LogBilinear, Trainer, Vocabulary, coded_words, sequences
from larkspur.llm.packing import _slots, plan_sequences
from larkspur.llm.simhash_dedup import LEAST_EQUAL_BYTES, fingerprint_of, index_positions
from larkspur.llm.suffix_array import common_prefixes, suffix_array, window_groups
from larkspur.llm.suffix_dedup import SPAN, anchors, digests
from larkspur.llm.tokens import WordIds, tokenizer_path

ODD = ["İstanbul ŉ Straße ﬁ don't I'LL <|endoftext|> x<|endoftext|>y", "ＡＢ １２ Σίσυφος é é  a b \x85 \x1c z\x0bq", "", "   ", "naïve, co-op's 123.45 ½ ²", " \n a", None]


@pytest.fixture(scope="module")
def words():
    return WordIds(tokenizer_path())


def same_ids(words, texts):
    ids, bounds = words.texts(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == words.whole.encode(t or "", add_special_tokens=False).ids, t


def test_ids_of_odd_texts(words):
    same_ids(words, ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_ids_equal_the_tokenizers(words, texts):
    same_ids(words, texts)


def test_coded_words_are_ascii_words():
    dictionary, which, bounds = coded_words(pa.array(ODD, pa.string()))
    for i, t in enumerate(ODD):
        assert [dictionary[k].as_py() for k in which[bounds[i] : bounds[i + 1]]] == ascii_words(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_plan_uses_every_piece_once_and_fits(lengths):
    counts = np.bincount(lengths, minlength=65) if lengths else np.zeros(65, np.int64)
    used, groups = np.zeros(65, np.int64), plan_sequences(counts, 64)
    for many, own in groups:
        assert sum(own) <= 64
        for x in own:
            used[x] += many
    assert (used == counts).all()
    assert sum(m for m, _ in groups) <= 2 * -(-sum(lengths) // 64) + 1
    keys, _, _ = _slots(groups)
    assert (np.diff(keys) > 0).all()


def test_plan_finds_exact_complements():
    counts = np.zeros(101, np.int64)
    counts[[60, 30, 10, 50, 99, 1]] = [3, 3, 3, 2, 1, 1]
    assert sum(m for m, _ in plan_sequences(counts, 100)) == 5


def brute_fingerprint(text):
    import xxhash

    w = ascii_words(text)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for k in range(64):
            bits[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * bits[k] > len(shingles))


@pytest.mark.parametrize("text", ["", None, " \n", "one", "one TWO", "a b c", "a b c d e f g a b c", "É x\x85y z " * 9])
def test_fingerprints(text):
    assert fingerprint_of(text) == brute_fingerprint(text)


def test_index_reaches_all_pairs_to_be_found():
    from itertools import combinations

    for n, size in ((0, 3), (1 << 24, 3), (1 << 30, 4), (1 << 40, 5)):
        sets = index_positions(n)
        assert {len(t) for t in sets} == {size} and len(sets) <= 56
        assert all(any(set(t) <= set(equal) for t in sets) for equal in combinations(range(8), LEAST_EQUAL_BYTES))


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=200).map(lambda b: bytes(x % 4 + 97 for x in b)))
def test_suffix_arrays(raw):
    text = np.frombuffer(raw, np.uint8)
    order = suffix_array(text).tolist()
    assert order == sorted(range(len(raw)), key=lambda i: raw[i:] + b"\xff")
    shared = common_prefixes(text, np.array(order, np.int64), 12)
    for i in range(1, len(raw)):
        a, b = raw[order[i - 1] :], raw[order[i] :]
        n = 0
        while n < 12 and n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert n == shared[i]


def test_window_groups():
    raw = b"abcabcxabc"
    at, group = window_groups(np.frombuffer(raw, np.uint8), np.arange(len(raw)) <= 7, 3)
    by = {}
    for a, g in zip(at.tolist(), group.tolist()):
        by.setdefault(g, set()).add(raw[a : a + 3])
    assert all(len(x) == 1 for x in by.values()) and len(by) == len({raw[i : i + 3] for i in range(8)})


def test_each_window_has_one_context_that_follows_from_its_bytes():
    rng = np.random.default_rng(0)
    passage = rng.integers(97, 123, 400).astype(np.uint8)
    found = []
    for pad in (0, 7, 333):
        raw = np.concatenate([rng.integers(97, 123, pad).astype(np.uint8), passage])
        text, a, first, last = anchors(raw, np.array([0, len(raw)]))
        digest = [tuple(g) for g in digests(raw.tobytes(), first, last + SPAN, b"salt").tolist()]
        assert first[0] == 0 and last[-1] == len(raw) - SPAN and (first[1:] == last[:-1] + 1).all() and (text == 0).all()
        found.append({d for d, f, e in zip(digest, first, last) if f > pad + SPAN and e < len(raw) - SPAN})
    assert found[0] & found[1] & found[2]


def test_network_gradients():
    net = ByteNetwork.fresh(["a", "b", "c"], 1)
    chars, inside = _padded([b"hello", b"wor"], 6)
    label = np.array([0, 2])
    grads, _ = net.gradients(chars, inside, label)
    for w, g in zip(net.weights(), grads, strict=True):
        i = np.unravel_index(np.abs(g).argmax(), w.shape)
        old = w[i]
        w[i] = old + 1e-2
        up = net.gradients(chars, inside, label)[1]
        w[i] = old - 1e-2
        down = net.gradients(chars, inside, label)[1]
        w[i] = old
        assert abs((up - down) / 2e-2 - g[i]) < 2e-3


def test_network_learns_and_reads_whole_texts():
    rng = random.Random(1)
    make = {"x": lambda: "".join(rng.choice("abcde ") for _ in range(200)), "y": lambda: "".join(rng.choice("fghij ") for _ in range(200))}
    crops = [(make[k]()[:64].encode(), k) for k in "xy" for _ in range(60)]
    net = fit([c for c, _ in crops], [k for _, k in crops], steps=60)
    names, score = classify(net, pa.array([make["x"](), make["y"](), None, "", "123 !!", make["x"]() * 30 + make["y"]() * 60]))
    assert names == ["x", "y", UNKNOWN, UNKNOWN, UNKNOWN, "y"] and (score[:2] > 0.8).all() and (score[2:5] == 0).all()


def test_network_with_one_language_or_none():
    assert classify(fit([b"abc"], ["x"]), pa.array(["abc"]))[0] == ["x"]
    assert classify(ByteNetwork.fresh([]), pa.array(["abc"]))[0] == [UNKNOWN]


def small_vocabulary():
    words = [(b"w%d" % i, 2000 // (i + 1)) for i in range(60)]
    return Vocabulary.of(words, np.arange(40) * 3.0, 500)


def test_clusters_hold_every_entry_once():
    v = small_vocabulary()
    assert sorted(v.members.tolist()) == list(range(101)) and v.starts[0] == 0 and v.starts[-1] == 101 and (np.diff(v.starts) > 0).all()
    assert all((v.cluster[v.members[a:b]] == k).all() for k, (a, b) in enumerate(zip(v.starts, v.starts[1:]))) and v.cluster[0] == 0
    t = Trainer(v)
    tokens = np.repeat(np.arange(101), 50)
    drawn = t.inner_noise(tokens, np.random.default_rng(0))
    assert (v.cluster[drawn] == v.cluster[tokens][:, None]).all() and abs(t.noise.sum() - 1) < 1e-9
    empty = Vocabulary.of([], np.zeros(40), 0)
    assert len(empty.mass) == 41 and empty.end == 40


def test_bilinear_model_is_normalised_and_learns():
    v = small_vocabulary()
    t = Trainer(v)
    model = LogBilinear.fresh(t)
    batch = sequences(np.tile([3, 20, 55], 3000), np.array([0, 9000]), v.end)
    ask = lambda e: model.log10(np.array([e]), np.array([20]), np.array([3]), v)[0]
    before = ask(55)
    for k in range(5):
        model.fit(batch, t, 0.3, k)
    assert ask(55) > before + 0.5
    token, one, two = np.tile(np.arange(101), 4), np.repeat([3, 20, 100, 101], 101), np.repeat([7, 3, 101, 101], 101)
    told = model.log10(token, one, two, v)
    assert np.allclose((10.0 ** told.reshape(4, 101)).sum(1), 1, atol=1e-4)
    for i in range(0, len(token), 17):  # the same from the definition, one token at a time
        g = np.append(model.context[one[i]] @ model.places[0] + model.context[two[i]] @ model.places[1], 1)
        c = v.cluster[token[i]]
        own = v.members[v.starts[c] : v.starts[c + 1]]
        first, second = np.exp(model.clusters @ g), np.exp(model.targets[own] @ g)
        p = first[c] / first.sum() * np.exp(model.targets[token[i]] @ g) / second.sum()
        assert abs(told[i] - np.log10(p)) < 1e-4


def test_gradients_raise_the_objective():
    """A step on few tokens raises their probability against the noise, on average."""
    v = small_vocabulary()
    t, rng = Trainer(v), np.random.default_rng(1)
    token, one, two = rng.integers(0, 101, 400), rng.integers(0, 101, 400), rng.integers(0, 101, 400)
    model = LogBilinear.fresh(t)
    before = model.log10(token, one, two, v).mean()
    for _ in range(30):
        model.learn(token, one, two, t, 0.3, rng)
    assert model.log10(token, one, two, v).mean() > before + 0.05


def test_sequences_start_and_end():
    token, one, two, text = sequences(np.array([5, 6]), np.array([0, 0, 2]), 9)
    assert text.tolist() == [0, 1, 1, 1] and one[0] == 10 and two[2] == 10 and two[3] == 5 and token[0] == token[3] == 9


def test_alignment():
    a = np.array([1, 2, 3, 4, 5])
    assert align(a, np.array([9, 1, 2, 3, 4, 5, 9])) == (10, 5)
    assert align(a, np.array([1, 2, 9, 4, 5]))[0] == 7 and align(a, np.array([1, 2, 9, 3, 4, 5]))[0] == 9


def test_edited_copies_are_found_and_others_left():
    rng = random.Random(2)
    vocabulary = ["w%d" % i for i in range(300)]
    item = " ".join(rng.choice(vocabulary) for _ in range(40))
    m = Matcher([(7, item, 1), (8, " ".join(rng.choice(vocabulary) for _ in range(40)), 1), (9, "ab", 1), (10, None, 1)])
    noise = " ".join(rng.choice(vocabulary) for _ in range(500))
    edited = " ".join("zz" if rng.random() < 0.2 else w for w in item.split())
    assert m.matches(noise) == [] and m.matches(None) == [] and m.matches("") == []
    found = m.matches(f"{noise} {item} {noise}")
    assert found == [(7, 1.0, 500, 539, 1)]
    assert [f[0] for f in m.matches(f"{noise} {edited}")] == [7]


PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Menu {0}</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class=ad>Buy {0}</div><article><h1>Head {0}</h1><p>One &amp; two<br>{0}\n x<p class=share>Share this</p><p><b>Bold</b> {0}</p><p>Follow us on everything</p></article><aside>Side {0}</aside><div id="comments">Nice {0}</div><form>Name</form><footer>Foot {0}</footer></body></html>'


def test_main_text():
    assert H.main_text(PAGE.format("A")) == "Head A\nOne & two A x\nBold A\nFollow us on everything"
    assert H.main_text(None) == "" and H.main_text("") == "" and H.main_text("<nav>x</nav>") == ""
    assert H.main_text("plain <b>text</b> only") == "plain text only"
    assert H.main_text("<body><div>a</div><div hidden>b</div><p>c &lt;d&gt;<p>e") == "a\nc <d>\ne"
    assert H.main_text("<p title='a>b'>x</p><p bad=\"y>z</p>") .startswith("x")


def test_template_of_a_wrapper():
    first, other = H.parse(PAGE.format("A")), H.parse(PAGE.format("B"))
    nodes, pairs = H.numbered(first), []
    H.match_trees(first, other, pairs)
    constant = {a.number for a, b in pairs if a.tag in H.BLOCKS and a.own_text() and a.own_text() == b.own_text()}
    assert "Follow us on everything" in {n.own_text() for n in nodes if n.number in constant}
    assert H.main_text(PAGE.format("C"), first, constant) == "Head C\nOne & two C x\nBold C"


def test_tree_matching_keeps_order_and_inserts():
    a, b = H.parse("<div><p>1</p><ul><li>x</li></ul><p>2</p></div>"), H.parse("<div><p>1</p><h2>new</h2><p>0</p><ul><li>x</li><li>y</li></ul></div>")
    pairs = []
    size = H.match_trees(a, b, pairs)
    assert size == len(pairs) == 5 and [x.tag for x, _ in pairs] == ["#page", "div", "p", "ul", "li"]


def brute_match(a, b):
    """Simple tree matching as it is written down: children aligned by a table of their own matches."""
    if a.label != b.label:
        return 0
    xs, ys = a.elements(), b.elements()
    table = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, x in enumerate(xs, 1):
        for j, y in enumerate(ys, 1):
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + brute_match(x, y))
    return 1 + table[-1][-1]


def test_tree_matching_against_the_plain_recursion():
    rng = random.Random(8)

    def tree(depth):
        kids = "" if depth == 0 else "".join(tree(depth - 1) for _ in range(rng.randint(0, 4)))
        tag = rng.choice(["div", "section", "b"])
        return f"<{tag}>{kids}</{tag}>"

    for _ in range(150):
        a, b = H.parse(tree(3) + tree(2)), H.parse(tree(3) + tree(2))
        pairs = []
        assert H.match_trees(a, b, pairs) == brute_match(a, b) == len(pairs)
        assert all(x.label == y.label for x, y in pairs) and len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
    one, two = H.parse("<div>x</div><div><p>a</p><p>b</p><p>c</p></div>"), H.parse("<div><p>a</p><p>b</p><p>c</p></div>")
    assert H.match_trees(one, two, []) == 5


def test_counts_told_to_shards_are_packed_whole(monkeypatch):
    """A shard's words and counts come out of its cells as they went in, in a quarter of the bytes."""
    rng = np.random.default_rng(4)
    rows = [(shard, int(at), int(c)) for shard in (0, 3, 70_000) for at, c in zip(rng.permutation(5000), rng.zipf(1.5, 5000).clip(1, (1 << 40) - 1))]
    rows += [(9, (1 << 23) - 1, (1 << 40) - 1), (9, 0, 1)]
    rng.shuffle(rows)
    shard, at, c = (np.array(x, np.int64) for x in zip(*rows))
    table = pa.table({"shard": shard, "told": (at << 40) + c})
    for most in (1 << 20, 100):
        monkeypatch.setattr(lm_score, "_TOLD", most)
        cells = [(s, cell) for b in lm_score._pack_counts(iter(table.to_batches(max_chunksize=64))) for s, cell in zip(b.column("shard").to_pylist(), b.column("told"))]
        got = sorted((s, int(i), int(n)) for s, cell in cells for i, n in zip(*lm_score._told(cell)))
        assert got == sorted(map(tuple, np.stack([shard, at, c], 1).tolist()))
        if most > len(rows):
            assert len(cells) == 4 and sum(len(cell.as_py()) for _, cell in cells) < 16 * len(rows) / 4
    assert list(lm_score._pack_counts(iter([]))) == []


def test_steps_of_training_equal_those_without_shared_copies():
    """Sums of weighted values are those of values multiplied beforehand."""
    rng = np.random.default_rng(6)
    near, weight, where = rng.normal(size=(300, 17)).astype(np.float32), rng.normal(size=(300, 5)).astype(np.float32), rng.integers(0, 90, 1500)
    one, two = lm_score._sums(where, (weight[:, :, None] * near[:, None, :]).reshape(-1, 17)), lm_score._sums(where, near, weight.ravel())
    assert all((a == b).all() for a, b in zip(one, two))
    for counts in ([5], [40] * 900, [10**9, *range(1, 3000), 10**7], [1] * 70_000):
        t = Trainer(Vocabulary.of([(b"w%d" % i, c) for i, c in enumerate(counts)], np.zeros(lm_score.SHARED), 3))
        at = np.concatenate([rng.random(3000) * t.sums[-1], t.sums, np.nextafter(t.sums, 0), np.nextafter(t.sums, 1e9)]).clip(0)
        assert (t.places(at) == np.searchsorted(t.sums, at, "right")).all()


def test_long_stretches_of_unlike_siblings_are_aligned(monkeypatch):
    """Siblings of more than 4 million pairs: as large a match as the plain table, in parts or as a whole."""
    rng = random.Random(9)
    kinds = ["<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<ul><li>{}</li><li>x</li></ul>", "<h2><b>{}</b></h2>"]
    a, b = (H.parse(first + "".join(rng.choice(kinds).format(i) for i in range(2100)) + last) for first, last in (("<div>1</div>", "<hr>"), ("<hr>", "<div>1</div>")))
    assert len(a.elements()) * len(b.elements()) > 4_000_000
    weigh = {(x.shape, y.shape): brute_match(x, y) for t in (a, b) if H._SHAPES.name(t) is None for x in a.elements() for y in b.elements()[:60]}
    row = [0] * (len(b.elements()) + 1)
    for x in a.elements():
        above, row = row, [0]
        for j, y in enumerate(b.elements()):
            row.append(max(above[j + 1], row[j], above[j] + weigh.get((x.shape, y.shape), 0)))
    whole = []
    assert H.match_trees(a, b, whole) == 1 + row[-1] == len(whole) == H.match_trees(a, b)
    monkeypatch.setattr(H, "CELLS", 7)
    monkeypatch.setattr(H.Shapes, "MOST", 3)
    pairs = []
    assert H.match_trees(a, b, pairs, H.Shapes()) == len(pairs) == H.match_trees(a, b, None, H.Shapes())
    assert [(id(x), id(y)) for x, y in pairs] == [(id(x), id(y)) for x, y in whole]
    rows = lambda n: H.parse("".join("<ul>" + "".join(rng.choice(["<li>x", "<li><b>y</b>", "<p>z</p>", "<ul><li>x<li>y</ul>"]) for _ in range(rng.randint(0, 6))) + "</ul>" for _ in range(n)))
    for _ in range(20):
        a, b = rows(rng.randint(0, 25)), rows(rng.randint(0, 25))
        found = []
        for cells, together, few in ((4_000_000, 256, 64), (4_000_000, 1, 64), (50, 1, 3), (9, 10_000, 0)):
            for name, value in (("CELLS", cells), ("TOGETHER", together), ("FEW_KIDS", few)):
                monkeypatch.setattr(H, name, value)
            pairs = []
            assert H.match_trees(a, b, pairs, H.Shapes()) == H.match_trees(a, b, None, H.Shapes()) == brute_match(a, b) == len(pairs)
            found.append([(id(x), id(y)) for x, y in pairs])
        assert found[0] == found[1] == found[2] == found[3]


def test_hostile_pages_take_linear_time_and_no_recursion():
    import time

    deep = "<div>" * 100_000 + "deep text" + "</div>" * 100_000
    assert H.main_text(deep) == "deep text"
    a, b = H.parse(deep), H.parse("<div>" * 99_000 + "x")
    pairs = []
    assert H.match_trees(a, b, pairs) == len(pairs) == 99_001
    began = time.time()
    n = 60_000
    for page in ("<a " * n, '<a href="' * n, "<b x='" * n + ">", '<a " > " ' * n, "<script " * n, "<!--" * n, "<" * n, "</x>" * n, "<div>" * n + "</p>" * n, "<span>" * n + "<li>a" * n, "<ul>" + "<li>x" * n, "<p>" * n, "&lt" * n, "<div>" * n + "<p>y" * n):
        H.main_text(page)
    assert time.time() - began < 60
    many = H.parse("".join(f"<p class=a{i % 7}>{i}</p>" for i in range(20_000)))
    others = H.parse("".join(f"<p class=b{i % 5}>{i}</p>" for i in range(20_000)))
    assert H.match_trees(many, others, []) == 1
    big = "<article>" + "<p>word and more words here</p>" * 330_000 + "</article>"
    assert len(big) > 10_000_000 and H.main_text(big).count("\n") == 329_999


def test_tags_of_common_and_other_forms(monkeypatch):
    """Tags read as a whole give what the steps give."""
    long = "x" * 300
    pages = ["<p>a</p >b<BR/>", f"<a href='{long}' title=\">\">x</a>", f"<{long}>y</{long}>", '<p t="a>b" u=\'"\'>z</p>', '<a href="q>x</a>', "<a" + " b='c'" * 12 + ">d", '<q"w>e', "<script a='>'>f</p></script >g", "<a/b>h<i", "<p " + "y" * 500 + ">k"]
    common = H._TAG
    for page in pages:
        whole = list(H.tokens(page))
        with monkeypatch.context() as m:
            m.setattr(H, "_TAG", H.re.compile("(?!)"))
            assert list(H.tokens(page)) == whole
    assert common.match(pages[3]) and not common.match(pages[1]) and not common.match(pages[5])


def test_licences():
    assert len({d for d, _, _ in catalogue()}) >= len(KNOWN)
    mit = KNOWN["MIT"][0]
    assert canonical_text(mit) == canonical_text(mit.upper().replace("LICENSE", "LICENCE").replace("<YEAR> <HOLDER>", "2020 X"))
    assert zlib.crc32(b"") == 0


def test_every_alignment_over_the_threshold_is_found(monkeypatch):
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(400)]
    pick = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = pick(24)
    items = [pick(30), shared + pick(12), shared + pick(12), pick(3), pick(5), pick(60)]
    m = Matcher([(i, " ".join(words), 1) for i, words in enumerate(items)])
    third = ["zz" if k % 3 == 2 else w for k, w in enumerate(items[0])]
    apart = [x for w in items[5] for x in (w, "zz")]
    assert [f[:2] for f in m.matches(" ".join(pick(90) + third + pick(90)))] == [(0, pytest.approx(0.5, abs=0.02))]
    assert [f[0] for f in m.matches(" ".join(pick(90) + apart + pick(90)))] == [5]
    assert sorted(f[0] for f in m.matches(" ".join(pick(90) + shared + pick(90)))) == [1, 2]
    for common in (64, 0):
        monkeypatch.setattr("larkspur.llm.decontaminate.COMMON", common)
        m = Matcher([(i, " ".join(words), 1) for i, words in enumerate(items)])
        for _ in range(150):
            doc = pick(20)
            for words in rng.sample(items, 2):
                wrong = rng.choice([0.1, 0.25, 0.33, 0.4])
                doc += [x for w in words for x in ([w] if rng.random() > wrong else rng.choice([[], ["zz"], [w, "zz"]]))] + pick(5)
            coded = np.array([m.numbers.get(w, 0) for w in doc])
            scores = {i: align(words, coded)[0] / (2 * len(words)) for i, words in m.items}
            assert {f[0]: f[1] for f in m.matches(" ".join(doc))} == {i: s for i, s in scores.items() if s >= 0.4 and 2 * len(items[i]) * s >= min(2 * len(items[i]), 9)}


def test_short_items_and_lone_phrases():
    m = Matcher([(1, "yes please", 1), (2, "Yes", 2), (3, "red green blue", 1), (4, "what is the capital of old rome", 1), (None, "on and on", 1)])
    ids = lambda text: [(f[0], f[2], f[3], f[4]) for f in m.matches(text)]
    assert ids("well, yes please do") == [(1, 1, 2, 1)] and ids("yes, and please") == [] and ids("YES!") == [(2, 0, 0, 2)]
    assert ids("a red green blue b") == [(3, 1, 3, 1)] and ids("a red green x blue") == []
    assert ids("this is the capital of a country") == [] and ids("what is the capital of new rome") == [(4, 0, 6, 1)]
    assert ids("and on and on it goes") == [(None, 1, 3, 1)]


def test_alignments_made_together_are_those_made_apart(monkeypatch):
    monkeypatch.setattr("larkspur.llm.decontaminate.ALIGN_CELLS", 300)
    rng = np.random.default_rng(3)
    pairs = [(rng.integers(1, 6, rng.integers(0, 30)), rng.integers(0, 6, rng.integers(0, 80))) for _ in range(300)]
    assert align_all(pairs) == [align(*p) for p in pairs]


def test_words_of_plain_texts():
    plain = "".join(map(chr, range(128))) * 2 + " A_b9\x1cC\x00d"
    assert words_of(plain) == words_of(plain + " é")[:-1]


def test_many_texts_are_searched_as_each(monkeypatch):
    """Texts of a batch are aligned together, in far fewer steps than words: each has a passage that is tried."""
    made = []
    monkeypatch.setattr("larkspur.llm.decontaminate.align_all", lambda pairs: made.append(len(pairs)) or align_all(pairs))
    m = Matcher([(1, "one two three four five six seven", 1), (2, "red green", 1), (3, "alpha beta gamma delta", 2)])
    texts = ["x one two three four five six seven", None, "", "red green alpha beta gamma delta alpha beta", "nothing", "one two three zero five six seven"] * 20
    found = m.matches_all(texts)
    assert len(made) == 2 and made[0] >= 60
    assert found == [m.matches(t) for t in texts] and [len(f) for f in found[:6]] == [1, 0, 0, 2, 0, 1]


def test_sums_keep_small_values_beside_large_ones():
    where = np.array([7] + [3] * 3 + [7] * 500)
    values = np.ones((len(where), 2), np.float32)
    values[0] = 1e8
    rows, sums, n = lm_score._sums(where, values)
    assert rows.tolist() == [3, 7] and n.tolist() == [3, 501]
    assert sums.dtype == np.float32 and sums[:, 0].tolist() == [3, np.float32(1e8 + 500)]


def test_log_sums_of_any_size():
    rng = np.random.default_rng(2)
    for scale in (1, 20, 500):
        x = rng.normal(0, scale, (50, 30)).astype(np.float32)
        assert np.allclose(lm_score._log_sum(x.copy()), np.logaddexp.reduce(x.astype(np.float64), axis=1), rtol=1e-5, atol=1e-5)
