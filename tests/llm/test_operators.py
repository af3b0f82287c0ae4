"""Each corpus operator on awkward tables, and against brute force on small ones."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import embedding_dedup, language_id, lm_score, simhash_dedup, suffix_dedup
from larkspur.llm.common import ascii_words, store
from larkspur.llm.components import connected_components
from larkspur.llm.decontaminate import contamination, drop_contaminated
from larkspur.llm.embedding_dedup import embedding_groups
from larkspur.llm.html_extract import extract_main_text, main_text
from larkspur.llm.language_id import identify, keep_identified
from larkspur.llm.license_scan import scan_licenses
from larkspur.llm.lm_score import score_texts
from larkspur.llm.packing import pack
from larkspur.llm.simhash_dedup import drop_near_duplicates, fingerprint_of, simhash_groups
from larkspur.llm.suffix_dedup import dedup_substrings, remove_repeats
from larkspur.llm.token_counts import TokenRollup, counted, deletes, inserts, revisions
from larkspur.llm.tokens import WordIds, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component string"
LONG = " ".join(f"word{i % 97} other{i % 89}" for i in range(30_000))


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    passage = words(1, 60)
    rows = [
        (0, None, None, None, None, None), (1, "", "en", "s", 0, "x"), (2, "   \n ", "en", "s", 5, "x"), (3, "123 !!", "de", "s", 6, "x"),
        (4, LONG, "en", "s", 7, "x"), (5, LONG, "en", "s", 7, "x"), (6, f"{words(2, 30)} {passage}", "en", None, 7, "x"), (7, f"{words(3, 30)} {passage} {words(4, 20)}", "de", "s", 7, "x"),
        (7, f"{words(3, 30)} {passage} {words(4, 20)}", "de", "s", 7, "x"), (8, "ÀÉ é\tx", "fr", "s", 7, "x"), (9, "one", "en", "s", 3, "x"), (10, "aa" * 200, "en", "s", 400, "x"), (11, words(5, 80), "en", "s", 3, "x"),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# components


def test_components_against_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).df.collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).df.count() == 0


# 1


def brute_cuts(rows):
    """(doc_id, text) in order of doc_id: bytes to go."""
    seen, out = set(), {}
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        out[doc] = (raw, gone)
    return out


def check_cuts(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in dedup_substrings(frame).collect()}
    for doc, (raw, gone) in brute_cuts(sorted(rows)).items():
        r = got[doc]
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()), doc


def repeated_texts():
    rng = random.Random(6)
    shared = [words(100 + i, 25) for i in range(6)]
    rows = []
    for i in range(40):
        parts = [words(200 + i, rng.randint(0, 40))] + [rng.choice(shared)[rng.randint(0, 20) :] + words(i, 3) for _ in range(rng.randint(0, 3))]
        rows.append((i, " ".join(parts)))
    return rows + [(40, "é" * 130), (41, "x" + "é" * 130), (42, "ab" * 300), (43, None), (44, ""), (45, rows[3][1]), (46, rows[3][1] + "!")]


@pytest.mark.parametrize("crowd", [10_000, 3])
def test_repeats_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    check_cuts(spark, repeated_texts())


def test_repeats_in_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 3000)
    check_cuts(spark, [(1, words(8, 3000)), (2, words(9, 900) + words(8, 3000)[5000:9000])])


def test_nothing_is_cut_that_occurs_once(spark, monkeypatch):
    """Texts that differ in bits which a weak digest would not see, in a crowd of contexts of one anchor."""
    monkeypatch.setattr(suffix_dedup, "CROWD", 2)
    rng = random.Random(11)
    base = [rng.choice(b"abcdefghijklmnopqrstuvwxyz ") for _ in range(100)]
    rows, seen = [], set()
    for k in range(600):
        own = base.copy()
        for p in (0, 8, 12, 16, 24, 40, 48, 64, 88):
            if rng.random() < 0.5:
                own[p] ^= 0x40 if own[p] < 96 else 0x01
        own[96] = 97 + k % 26
        if bytes(own) not in seen:
            seen.add(bytes(own))
            rows.append((k, bytes(own).decode("ascii", "replace").replace(chr(127), "~")))
    check_cuts(spark, list({t: (k, t) for k, t in rows}.values()))


def test_a_crowd_of_one_anchor(spark):
    """Over 10,000 contexts that all choose the same anchor, some of which repeat windows of others."""
    rng = random.Random(3)
    least = min((bytes(rng.choice(b"abcdefgh") for _ in range(24)) for _ in range(60_000)), key=lambda g: int(suffix_dedup._mix([np.array([int.from_bytes(g[k : k + 8], "big")], np.uint64) for k in (0, 8, 16)], 0)[0]) << 22 & (1 << 64) - 1)
    rows = [(i, f"{rng.randrange(10**9):09d}" * 5 + least.decode() + f"{rng.randrange(10**9):09d}" * 5) for i in range(10_400)]
    rows += [(20_000 + i, "x" + rows[i * 7][1][3:] + "y") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    texts = frame.withColumn("row", F.lit(0).cast("long"))
    crowd = suffix_dedup._contested(texts)[1].groupBy("anchor").count().agg(F.max("count")).first()[0]
    assert crowd > suffix_dedup.CROWD == 10_000
    check_cuts(spark, rows)


def test_short_stretches_match_nothing_across_texts():
    texts = [b"a" * 30, b"b" * 120, b"a" * 30 + b"c" * 120]
    table = pa.table({"bytes": pa.array(texts, pa.binary()), "doc_id": [1, 2, 3], "row": [0, 0, 0], "start": [0, 0, 0], "crowded": [False] * 3})
    found = pa.Table.from_batches(suffix_dedup._search_shard(table, 0, b"s" * 16)).to_pylist()
    assert {r["doc_id"] for r in found} == {2, 3} and all(r["start"] == (1 if r["doc_id"] == 2 else 31) for r in found)


def test_rows_with_one_id_and_unlike_texts(spark):
    a, z = words(1, 30), words(2, 30)
    frame = spark.createDataFrame([(1, a, 0), (2, z[:200] + a, 0), (2, "short", 0), (2, a[50:] + z, 0), (3, "q" + z, 0), (None, a, 0), (None, a, 0), (2, "short", 0)], "doc_id long, text string, n_chars int")
    rows = suffix_dedup._with_rows(frame).collect()
    order = sorted({(r["doc_id"], r["row"], r["text"]) for r in rows if r["doc_id"] is not None})
    want = {k: np.frombuffer(raw, np.uint8)[~gone].tobytes() for k, (raw, gone) in brute_cuts([((d, r), t) for d, r, t in order]).items()}
    got = sorted(r["kept_sha256"] for r in dedup_substrings(frame).collect() if r["doc_id"] is not None)
    twice = [hashlib.sha256(want[d, r]).hexdigest() for d, r, t in order] + [hashlib.sha256(b"short").hexdigest()]
    assert got == sorted(twice)
    kept = remove_repeats(frame)
    assert sorted(r["text"].encode() for r in kept.where("doc_id is not null").collect()) == sorted([*want.values(), b"short"])
    assert [r["text"] for r in kept.where("doc_id is null").collect()] == [a, a] and kept.columns == frame.columns


def test_clashing_names_in_cuts(spark):
    a = words(1, 30)
    frame = spark.createDataFrame([(1, a), (2, a)], "doc_id long, text string").select("*", *[F.lit(k).alias(c) for k, c in enumerate(("cut_doc_id", "cut_row", "cuts", "row", "start", "a.b"))])
    kept = {r["doc_id"]: r for r in remove_repeats(frame).collect()}
    assert kept[2]["text"] == "" and kept[1]["text"] == a and tuple(kept[2])[2:] == (0, 1, 2, 3, 4, 5)


def test_repeats_of_awkward_rows(awkward, nothing):
    got = dedup_substrings(awkward).collect()
    assert len(got) == 13
    by = {r["doc_id"]: r for r in got}
    assert by[0]["n_bytes"] == 0 and by[5]["n_removed"] == by[5]["n_bytes"] and by[5]["n_spans"] == 1 and by[7]["n_removed"] > 100
    assert by[0]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert dedup_substrings(nothing).count() == 0
    kept = remove_repeats(awkward)
    assert kept.columns == awkward.columns and {r["doc_id"]: r["n_chars"] for r in kept.collect()}[5] == 0


# 2


def test_languages(spark, awkward, nothing):
    rng = random.Random(3)
    alphabets = {"en": "theandofi ", "de": "schungrü "}
    rows = [(i, "".join(rng.choice(alphabets[k]) for _ in range(150)), k) for i in range(160) for k in [("en", "de")[i % 2]]]
    frame = spark.createDataFrame([*rows, (500, None, "en"), (501, "12 34", "de"), (None, "the and of the", None)], "doc_id long, text string, lang string")

    def quick(docs):
        text = [(r["text"][:64].encode(), r["lang"]) for r in docs.where("lang is not null and text is not null and doc_id < 400").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
        return language_id.fit([c for c, _ in text], [k for _, k in text], steps=80)

    got = {r["doc_id"]: r for r in identify(frame, quick).collect()}
    held = [i for i in range(160) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(160))
    assert np.mean([got[i]["lang_pred"] == ("en", "de")[i % 2] for i in held]) > 0.95
    assert (got[500]["lang_pred"], got[501]["lang_pred"], got[501]["score"]) == ("und", "und", 0.0) and got[None]["held_out"] is False
    kept = keep_identified(frame, quick)
    assert kept.columns == frame.columns and {500, 501}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert identify(nothing).count() == 0
    unlabelled = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in identify(unlabelled).collect()} == {"und"}


# 3


def test_licences(spark, awkward, nothing):
    from larkspur.llm.license_scan import KNOWN

    mit = KNOWN["MIT"][0].replace("<year> <holder>", "2021 Someone").replace("License", "LICENCE")
    rows = [(1, mit), (2, "Hello.\n  released UNDER the mit licence\nbye"), (3, None), (4, "Released under the MIT License. And more"), (5, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (5, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.")]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["whole_license"] == "MIT" and got[2]["line_licenses"] == "MIT-notice" and got[2]["whole_license"] is None
    assert got[3]["canonical_sha256"] == hashlib.sha256(b"").hexdigest() and got[4]["line_licenses"] == ""
    assert got[5]["line_licenses"] == "CC-BY-NC-4.0-notice,MIT-notice" and got[5]["n_license_lines"] == 4
    assert scan_licenses(awkward).count() == 12 and scan_licenses(nothing).count() == 0
    assert "Python" not in scan_licenses(awkward)._jdf.queryExecution().executedPlan().toString()


def test_whole_licences(spark):
    from larkspur.llm.license_scan import KNOWN, catalogue

    digests = [d for d, _, _ in catalogue()]
    assert len(digests) == len(set(digests)) and hashlib.sha256(b"").hexdigest() not in digests
    whole = {n: t for n, texts in KNOWN.items() for t in texts if len(t) > 500}
    assert {"Apache-2.0", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "MIT", "MPL-2.0", "Unlicense"} <= set(whole)
    untitled = {n: t.strip().split("\n\n" if "\n\n" in t else "\n", 1)[1] for n, t in whole.items() if n != "BSD-3-Clause"}
    flowed = {n: "\n\n".join(p.replace("\n", " ") for p in whole[n].split("\n\n")) for n in ("Apache-2.0", "MPL-2.0", "LGPL-2.1")}
    unlicense = "This is free and unencumbered software released into the public domain.\n\n" + whole["Unlicense"].split("\n", 2)[2].replace("\n", "\n\n")
    cases = [*whole.items(), *untitled.items(), *flowed.items(), ("Unlicense", unlicense), ("BSD-3-Clause", KNOWN["BSD-3-Clause"][0].replace("<year>, <holder>", "2020, X"))]
    rows = [(i, text) for i, (_, text) in enumerate(cases)]
    got = {r["doc_id"]: r["whole_license"] for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(i, name) for i, (name, _) in enumerate(cases)} == set(got.items())
    cut = whole["Unlicense"].split("\nIn jurisdictions")[0]
    assert scan_licenses(spark.createDataFrame([(1, cut)], "doc_id long, text string")).first()["whole_license"] is None


# 4


def test_rollups_by_deltas(spark, awkward, nothing, tmp_path):
    rollup = TokenRollup(spark, f"file://{tmp_path}/r")
    versions = {"w": None, "b": tokenizer_path()}
    assert rollup.totals().count() == 0 and rollup.batches() == []
    rows = store(counted(awkward, versions), "counted").df
    assert rollup.commit("one", inserts(rows)) and not rollup.commit("one", inserts(rows))
    want = Counter()
    coder = WordIds(tokenizer_path())
    for r in awkward.collect():
        for v in versions:
            n = len(ascii_words(r["text"])) if v == "w" else len(coder.whole.encode(r["text"] or "", add_special_tokens=False).ids)
            want[(r["source"], r["lang"], v, "docs")] += 1
            want[(r["source"], r["lang"], v, "tokens")] += n
    for t in rollup.totals().collect():
        assert t["n_docs"] == want[(t["source"], t["lang"], t["tokenizer"], "docs")] and t["n_tokens"] == want[(t["source"], t["lang"], t["tokenizer"], "tokens")]
    gone = rows.where("doc_id = 4")
    rollup.commit("two", deletes(gone))
    moved = rows.where("doc_id = 9")
    rollup.commit("three", revisions(moved, moved.withColumn("lang", F.lit("it")).withColumn("n_tokens", F.lit(5).cast("long"))))
    now = {(t["source"], t["lang"], t["tokenizer"]): t for t in rollup.totals().collect()}
    assert now[("s", "it", "w")]["n_tokens"] == 5 and now[("s", "en", "w")]["n_docs"] == want[("s", "en", "w", "docs")] - 2
    rollup.commit("four", deletes(rows.where("doc_id <> 4 and doc_id <> 9")))
    assert {k[1] for k in {(t["source"], t["lang"], t["tokenizer"]) for t in rollup.totals().collect()}} == {"it"}
    (tmp_path / "r-pending" / "broken").mkdir(parents=True)  # a batch that broke off while it was written
    assert rollup.batches() == ["four", "one", "three", "two"] and not rollup.is_committed("broken")
    before = sorted(map(str, rollup.totals().collect()))
    for _ in range(2):
        rollup.compact()
        assert sorted(map(str, rollup.totals().collect())) == before and rollup.batches() == ["four", "one", "three", "two"]
    assert not rollup.commit("one", inserts(rows)) and rollup.commit("five", inserts(rows.where("doc_id = 4")))
    rollup.commit("six", deletes(rows.where("doc_id = 4")))
    assert sorted(map(str, rollup.totals().collect())) == before
    assert rollup._move(f"file://{tmp_path}/nowhere", f"{rollup.path}/batch=six") is False
    with pytest.raises(ValueError):
        rollup.commit("../x", inserts(rows))


def test_rollup_of_words_equals_sql(spark, tmp_path):
    import duckdb

    from larkspur.llm.queries import ORACLES, token_rollup_words

    rows = [(1, "a b  c\u00a0d", "en", "s", 7), (2, None, "en", "s", 0), (3, "", None, "s", 0), (4, "x\ty\x0bz", None, None, 5), (5, "é", "fr", "s", 1), (6, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted(map(str, (r.asDict().items() for r in token_rollup_words(spark, f"file://{tmp_path}").collect())))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(ORACLES["token_rollup_words"])
    names = [d[0] for d in found.description]
    assert got == sorted(str(dict(zip(names, r)).items()) for r in found.fetchall())


# 5


def test_pages(spark):
    page = "<html><body><nav>Menu {0}</nav><article><h1>T{0}</h1><p>Same on all pages</p><p>Own {0}</p></article><footer>F</footer></body></html>"
    rows = [(i, f"https://a.example/{i}", page.format(i)) for i in range(6)] + [(10, "https://b.example/1", page.format(1)), (11, None, page.format(2)), (12, "https://a.example/x", None), (13, "https://a.example/y", ""), (14, "nonsense", "<p>x"), (14, "nonsense", "<p>x")]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 12 and by[3]["text"] == "T3\nOwn 3" and by[10]["text"] == "T1\nSame on all pages\nOwn 1" and by[11]["text"].endswith("Own 2")
    assert by[12]["text"] == "" and by[13]["n_chars"] == 0 and by[14]["text"] == "x" and by[3]["n_chars"] == 8
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers_decide_and_may_be_of_any_size(spark, monkeypatch):
    """Boilerplate without telling names: only the wrapper knows it; joined or broadcast, the result is the same."""
    page = "<html><body><div><span>Site {h}</span></div><div><p>Text {n} of the page</p><p>All rights belong to {h}</p></div><div>End of {h}</div></body></html>"
    rows = [(10 * h + n, f"http://h{h}.org/{n}", page.format(h=h, n=n)) for h in range(3) for n in range(6)] + [(99, "http://lone.org/", page.format(h=9, n=1)), (100, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in extract_main_text(frame).collect()}
    assert all(got[10 * h + n] == f"Text {n} of the page" for h in range(3) for n in range(6)) and got[99].startswith("Site 9") and got[100] == ""
    plain = {i: main_text(html) for i, _, html in rows}
    assert sum(got[i] != plain[i] for i in got) == 18
    monkeypatch.setattr("larkspur.llm.html_extract.BROADCAST_BYTES", -1)
    assert {r["page_id"]: r["text"] for r in extract_main_text(frame).collect()} == got


def test_pages_of_a_host_with_two_layouts(spark):
    one = "<html><body><div class=a><p>Hello from one</p><div class=b><h1>T{0}</h1><p>Own {0}</p></div>{1}</div></body></html>"
    two = "<html><body><section class=c><div>Hello from two</div><table><tr><td>Own {0}</td></tr></table></section>{1}</body></html>"
    hint = "<section class=hint>Closed in winter</section>"
    rows = [(i, f"https://a.example/{i}", one.format(i, hint * (i % 2))) for i in range(8)] + [(i, f"https://a.example/{i}", two.format(i, "")) for i in range(10, 14)]
    rows += [(i, f"https://a.example/{i}", f"<html><body><p>Error {i}</p></body></html>") for i in range(20, 22)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    want = {i: f"T{i}\nOwn {i}" for i in range(8)} | {i: f"Own {i}" for i in range(10, 14)} | {20: "Error 20", 21: "Error 21"}
    assert got == want


# 6


def test_scores(awkward, nothing):
    got = score_texts(awkward).collect()
    rows = [(r["doc_id"], ascii_words(r["text"])) for r in awkward.collect()]
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    c = Counter()
    for d, w in rows:
        if not held[d]:
            c.update([*w, None])
    n, v = sum(c.values()), len(c)
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for d, w in rows:
        own = [*w, None]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own)
        r = by[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(own), sum(c[x] > 0 for x in own), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and -math.inf < r["score"] < 0
    assert score_texts(nothing).count() == 0


def test_scores_do_not_depend_on_how_the_input_is_cut(spark, monkeypatch):
    """Documents with an order of words that a unigram can't know: scores above the base, the same however they come."""
    monkeypatch.setattr(lm_score, "SHARD_BYTES", 100_000)
    rng = random.Random(3)
    follow = {f"w{i}": [f"w{(3 * i + k) % 200}" for k in range(3)] for i in range(200)}

    def text(n):
        out = ["w1"]
        for _ in range(n):
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(out)

    rows = [(i, text(150)) for i in range(400)] + [(None, text(20)), (None, text(20)), (None, None), (None, None), (None, ""), (7, text(9)), (400, "rare words only here"), (401, " \n ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["base_score"])
    one, two = (sorted(score_texts(frame.repartition(n)).collect(), key=key) for n in (1, 7))
    assert len(one) == len(two) == len(rows)
    assert all(a["doc_id"] == b["doc_id"] and abs(a["score"] - b["score"]) < 1e-3 and abs(a["base_score"] - b["base_score"]) < 1e-6 for a, b in zip(one, two))
    held = [r for r in one if r["held_out"] and r["n_tokens"] > 100]
    assert len(held) > 20 and np.mean([r["score"] > r["base_score"] + 3 for r in held]) > 0.95
    blank = [r for r in one if r["n_tokens"] == 1]
    assert len(blank) == 4 and len({r["score"] for r in blank if r["doc_id"] is None}) == 1


# 7


def test_embeddings_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    rows, k = [], 0
    for c in centres:
        for _ in range(int(rng.integers(1, 6))):
            x = c + rng.normal(size=16) * rng.choice([0, 0.02, 0.2])
            rows.append((k, x.astype("f4").tolist(), 1))
            k += 1
    tight = rng.normal(size=16)
    rows += [(k + i, (tight + rng.normal(size=16) * 0.01).astype("f4").tolist(), 2) for i in range(40)]
    odd = [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [float("nan")] + [1.0] * 15, 0), (905, [None] + [1.0] * 15, 0)]
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    got = {r["vec_id"]: r for r in embedding_groups(spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, component int").repartition(3)).collect()}
    x = embedding_dedup.unit_rows(np.array([r[1] for r in rows], np.float32))
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    found = sum(got[i]["n_links"] for i in range(len(rows)))
    assert 0.98 * near.sum() <= found <= near.sum()
    first = embedding_dedup._reach(near)
    assert np.mean([got[i]["component_id"] == first[i] for i in range(len(rows))]) > 0.95
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 903, 905))
    assert embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert embedding_groups(spark.createDataFrame(odd[:1], "vec_id long, embedding array<float>, l int")).count() == 1


@pytest.mark.parametrize("common", [0.0, 0.5, 0.7])
def test_recall_where_all_vectors_have_a_common_direction(spark, common):
    """Unrelated vectors at a cosine of common, pairs between 0.9 and 0.93: recall against brute force."""
    rng = np.random.default_rng(5)
    n, dim = 1500, 48
    axis = np.zeros(dim)
    axis[0] = 1
    own = rng.normal(size=(n, dim)) * (np.arange(dim) > 0)
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    x = np.sqrt(common) * axis + np.sqrt(1 - common) * own
    aside = rng.normal(size=(n // 2, dim))
    aside -= (aside * x[: n // 2]).sum(1, keepdims=True) * x[: n // 2]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cos = rng.uniform(0.9, 0.93, (n // 2, 1))
    x[n // 2 :] = cos * x[: n // 2] + np.sqrt(1 - cos**2) * aside
    x *= rng.uniform(0.1, 9, (n, 1))
    unit = embedding_dedup.unit_rows(x)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r["n_links"] for r in embedding_groups(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert 0.97 * near.sum() <= sum(got.values()) <= near.sum() and all(got[i] <= near[i].sum() for i in got)


def test_vectors_of_every_length_are_compared(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 4)
    rng = np.random.default_rng(2)
    rows = [(0, [1.0, 2.0]), (1, [2.0, 4.0]), (2, [1e300, 2e300]), (3, [1e-310, 2e-310]), (4, [-1.0, -2.0]), (5, [3.0]), (6, [4.0]), (7, [-4.0]), (8, [1.0, 2.0])]
    rows += [(10 + i, [float(i + 1)]) for i in range(9)] + [(30 + i, rng.normal(size=3).tolist()) for i in range(40)] + [(100 + i, rng.normal(size=200).tolist()) for i in range(3)]
    got = {r["vec_id"]: r for r in embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    units = {i: embedding_dedup.unit_rows(np.array([v]))[0] for i, v in rows}
    for i, v in rows:
        want = sum(1 for j, w in rows if j != i and len(v) == len(w) and units[i] @ units[j] >= 0.9)
        assert got[i]["n_links"] == want, i
    assert got[8]["component_id"] == got[3]["component_id"] == 0 and got[4]["component_id"] == 4 and got[18]["component_id"] == 5


# 8


def test_packing_is_a_round_trip(awkward, nothing):
    got = pack(awkward, capacity=512).collect()
    coder = WordIds(tokenizer_path())
    want = Counter()
    for r in awkward.collect():
        ids = np.array([*coder.whole.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), 512)):
            want[(r["doc_id"], k, a, len(ids[a : a + 512]), zlib.crc32(ids[a : a + 512].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    room = {}
    for r in got:
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in room.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 512
    assert len(room) <= -(-sum(r["length"] for r in got) // 512) + 1
    assert pack(nothing).count() == 0


# 9


def test_contamination(spark, awkward, nothing):
    items = spark.createDataFrame([(1, words(50, 30), 0), (2, words(51, 30), 0), (2, words(51, 30), 0), (3, None, 0), (None, "a b c d", 0), (4, "short", 0)], "item_id long, text string, doc_id int")
    docs = spark.createDataFrame([(1, f"{words(60, 100)} {words(50, 30)} {words(61, 9)}"), (2, words(62, 200)), (3, None), (4, words(51, 30)), (4, words(51, 30))], "doc_id long, text string")
    got = contamination(docs, items).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 5 and by[1]["best_item"] == 1 and by[1]["best_score"] == 1.0 and (by[1]["first_word"], by[1]["last_word"]) == (100, 129)
    assert not by[2]["contaminated"] and by[3]["best_item"] is None and by[4]["n_items"] == 2
    assert {r["doc_id"] for r in drop_contaminated(docs, items).collect()} == {2, 3}
    assert contamination(nothing, items).count() == 0
    assert not any(r["contaminated"] for r in contamination(awkward, items.limit(0)).collect())


def test_contamination_does_not_depend_on_blocks(spark, monkeypatch):
    """A benchmark in many blocks, each searched in a round of its own, gives what one block gives."""
    items = spark.createDataFrame([(i % 9 or None, words(500 + i % 20, 5 + i % 20)) for i in range(40)] + [(50, "two words"), (51, "w")], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(words(500 + j, 5 + j) for j in (i % 20, 3 * i % 20)) + (" two words" if i % 4 == 0 else "")) for i in range(12)] + [(12, "w"), (None, words(503, 8)), (None, None)], "doc_id long, text string").withColumn("a.b", F.lit(1))
    rows = lambda frame: sorted(tuple(str(x) for x in r) for r in frame.collect())
    whole, kept = rows(contamination(docs, items)), rows(drop_contaminated(docs, items))
    assert any(r[0] == "12" and r[1] == "1" for r in whole)
    monkeypatch.setattr("larkspur.llm.decontaminate.BLOCK_BYTES", 700)
    assert rows(contamination(docs, items)) == whole and rows(drop_contaminated(docs, items)) == kept


# 10


def test_simhash_against_brute_force(spark, awkward, nothing):
    base = words(70, 400).split()
    rng = random.Random(9)
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    for i in range(30):
        own = list(base)
        for _ in range(i % 6):
            own[rng.randrange(len(own))] = "zz"
        rows.append((100 + i, " ".join(own)))
    got = simhash_groups(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string").repartition(3)).collect()
    marks = {d: fingerprint_of(t) for d, t in rows}
    parent = {d: d for d in marks}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in marks:
        for b in marks:
            if a < b and (marks[a] ^ marks[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{marks[d]:016x}", find(d)) for d in marks}
    kept = drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4, 6, 7, 8, 9, 10, 11]
    assert simhash_groups(nothing).count() == 0 and drop_near_duplicates(nothing).count() == 0


def test_links_of_fingerprints_against_brute_force(spark):
    """Dense groups, chains and lone fingerprints: groups equal those over all pairs."""
    rng = random.Random(4)
    marks = {0, (1 << 64) - 1}
    for _ in range(12):
        chain = rng.getrandbits(64)
        for _ in range(25):
            marks.add(chain)
            for _ in range(rng.randint(1, 3)):
                chain ^= 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    marks |= {centre ^ 1 << a ^ 1 << b for a in range(12) for b in range(12)} | {rng.getrandbits(64) for _ in range(200)}
    signed = sorted(m - (1 << 64) if m >> 63 else m for m in marks)
    parent = {m: m for m in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    frame = spark.createDataFrame([(m,) for m in signed], "fingerprint long")
    for size in (0, 1 << 30, 1 << 40):
        positions = simhash_dedup.index_positions(size)
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(simhash_dedup, "index_positions", lambda n, own=positions: own)
            got = {r["node"]: r["component"] for r in simhash_dedup.linked_fingerprints(frame).df.collect()}
        assert got == {m: find(m) for m in signed}


def test_near_duplicates_keep_a_row_of_every_group(spark):
    a, b, c = words(1, 50), words(2, 50), words(3, 50)
    rows = [(None, a, "x"), (None, a, "x"), (None, b, "x"), (5, b, "x"), (7, a + " more", "x"), (7, c, "x"), (7, c, "x"), (None, None, "x"), (9, "", "y"), (8, None, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(3)
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash_groups(frame).collect())
    assert sum(got.values()) == len(rows)
    near = (fingerprint_of(a) ^ fingerprint_of(a + " more")).bit_count() <= 3
    assert got[(None, 5)] == 1 and got[(5, 5)] == 1 and got[(None, 8)] == 1 and got[(9, 8)] == 1 and got[(8, 8)] == 1
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in drop_near_duplicates(frame).collect())
    assert kept == sorted([(5, b), (7, c), (8, ""), *([(7, a + " more")] if near else [(0, a), (7, a + " more")])])
    only = drop_near_duplicates(spark.createDataFrame([(None, a), (None, a), (None, b)], "doc_id long, text string")).collect()
    assert sorted(r["text"] for r in only) == sorted([a, b])


def test_packing_keeps_rows_without_ids(spark):
    got = pack(spark.createDataFrame([(None, "a b c"), (None, None), (1, "a")], "doc_id long, text string")).collect()
    assert Counter(r["doc_id"] for r in got) == {None: 2, 1: 1}


# the pipeline


def test_pipeline_stages_keep_the_columns(spark, awkward, tmp_path):
    benchmark = [(1, words(5, 80))]
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = awkward.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = store(stage(spark, docs, f"file://{tmp_path}"), name).df
        assert docs.columns == awkward.columns
        seen[name] = {r["doc_id"] for r in docs.collect()}
    assert {0, 1, 2, 3}.isdisjoint(seen["language_id"])
    assert 5 not in seen["simhash_near_dedup"] and seen["suffix_array_dedup"] == seen["simhash_near_dedup"]
    assert 11 in seen["suffix_array_dedup"] and 11 not in seen["benchmark_decontamination"]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, f"file://{tmp_path}")
    assert {r["doc_id"] for r in last.collect()} == seen["benchmark_decontamination"]
