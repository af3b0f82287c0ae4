"""The whole pipeline against a plain fold in Python, golden prompts, awkward rows, and what is built around it."""

import hashlib
import json
import os
import re
import threading
from collections import defaultdict
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from larkspur.functions import actions, spans
from larkspur.operators import backends, languages, tokens
from larkspur.operators.grammar import Tagger, Word, like_a_name, trimmed
from larkspur.operators.remote import ask, remote_plugin
from larkspur.operators.reversible import apply_operators, deanonymize
from larkspur.plans.firewall import Firewall, mock_model
from larkspur.plans.queries import _messages
from larkspur.sdk import Sdk
from larkspur.sources import models
from larkspur.sources.catalog import Catalog, spelled_out
from larkspur.sources.entities import SPANS_SQL, rank_of
from larkspur.sources.languages import LOCALES
from larkspur.sources.profiles import Disposition, Profile, preset
from larkspur.sources.prompts import parse_prompts

MESSAGE = "tenant_id string, case_id string, thread_id string, msg_seq long, lang string, text string"
ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


# a plain fold over messages in order


def found_in(text, lang):
    low, out = text.lower(), []
    for nth, p in enumerate(Catalog.default().for_locale(LOCALES.get(lang or "en", "GLOBAL"))):
        for part, a, b in p.match(text):
            near = any(w in low[max(0, a - 100) : b + 100] for w in p.context_words)
            out.append([a, nth, b, part, p.entity_type, min(1.0, p.confidence + 0.25) if near else p.confidence])
    kept = []
    for s in sorted(out, key=lambda s: s[:2]):
        if not kept or s[0] >= kept[-1][2]:
            kept.append(s)
            continue
        last = kept[-1]
        if (s[0], s[2]) == (last[0], last[2]):
            wins = s[5] > last[5]
        else:
            wins = (rank_of(s[4]), s[2] - s[0], s[5]) > (rank_of(last[4]), last[2] - last[0], last[5])
        if wins:
            kept[-1] = s
    return kept


def folded(rows, profile):
    """[(sanitized text, originals by token)] of (tenant, lang, text) in order, tenant scope."""
    numbers, out = defaultdict(dict), []
    for tenant, lang, text in rows:
        if text is None:
            out.append(None)
            continue
        good = [s for s in found_in(text, lang) if (d := profile.get(s[4])) and s[5] >= d.confidence_threshold]
        pieces, end = [], len(text)
        for a, _, b, part, kind, _ in reversed(good):
            d = profile.get(kind)
            if d.action == "pseudonymize":
                own = numbers[tenant, kind]
                new = f"[{kind}_{own.setdefault(part.lower().strip(), len(own) + 1):03d}]"
            elif d.action == "mask":
                new = "*" * (len(part) - 4) + part[-4:] if len(part) > 4 else "*" * len(part)
            elif kind == "AGE":
                n = int(re.search(r"\b\d{1,3}\b", part)[0])
                new = f"{n // 10 * 10}-{n // 10 * 10 + 9}" if n <= 130 else "[AGE]"
            else:
                year = re.search(r"\b(?:19|20)\d{2}\b", part)
                new = year[0] if year else f"[{kind}]"
            pieces += [text[b:end], new]
            end = a
        text = "".join([text[:end], *reversed(pieces)])
        for _ in range(actions.PASSES):
            for rx, kind in actions.RESIDUAL:
                text = re.sub(rx, f"[{kind}]", text)
        out.append(text)
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data on this machine")
def test_documents_against_a_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["source"], r["lang"], r["text"]) for r in docs.select("doc_id", "source", "lang", "text").collect())
    rows = [(i, s, lang, t) for i, (_, s, lang, t) in enumerate(rows)]
    extra = [(len(rows) + i, "web", lang, text) for i, (lang, text) in enumerate([("en", "mail a@x.com or A@X.com, 10.0.0.1"), ("es", "DNI 12345678A, tel +34612345678, 43 años"), ("de", "am 20.06.1985 a@x.com"), ("fr", "IBAN FR7630006000011234567890189"), (None, "card 4111-1111-1111-1111"), ("en", "½12345678A mail x@y.org😀z")])]
    frame = spark.createDataFrame([(i, s, lang, t) for i, s, lang, t in rows + extra], "doc_id long, source string, lang string, text string")
    made = Firewall.create().anonymize(_messages(frame))
    got = {r["msg_seq"]: r["sanitized_text"] for r in made.messages.collect()}
    want = folded([(s, lang, t) for _, s, lang, t in rows + extra], preset("generic"))
    assert [got[i] for i in range(len(want))] == want


def _prompts():
    text = (ROOT / "FIXTURES.md").read_text() if (ROOT / "FIXTURES.md").exists() else ""
    found = re.findall(r"^([a-z]{2})(\d+)\s+in  (.*)\n     spans .*\n     out (.*)$", text, re.M)
    return [(lang, int(n), given, given if out == "(unchanged)" else out) for lang, n, given, out in found]


@pytest.mark.skipif(not _prompts(), reason="no fixtures here")
def test_golden_prompts(spark):
    prompts = _prompts()
    assert len(prompts) == 60
    rows = [(lang, "c", "h", n, lang, given) for lang, n, given, _ in prompts]
    got = {(r["tenant_id"], r["msg_seq"]): r["sanitized_text"] for r in Firewall.create().anonymize(spark.createDataFrame(rows, MESSAGE)).messages.collect()}
    assert [got[lang, n] for lang, n, _, _ in prompts] == [out for *_, out in prompts]


# awkward rows


@pytest.mark.parametrize("scope", ["tenant", "case", "thread"])
def test_no_original_goes_out_whatever_the_keys(spark, scope):
    text = "my ip 10.20.30.40 and mail ann@x.org"
    keys = [(None, "c", "h", 1), ("t", None, "h", 1), ("t", "c", None, 1), (None, None, None, 1), ("t", "c", "h", None), ("t", "c", "h", 10**18), ("t", "c", "h", 7), ("t", "c", "h", 7)]
    frame = spark.createDataFrame([(*k, "en", text) for k in keys] + [("t", "c", "h", 7, "en", "other bob@y.org"), ("t", "c", "h", 7, "en", None)], MESSAGE)
    made = Firewall.create(token_scope=scope).secure_call(frame, mock_model).collect()
    assert len(made) == 10
    for r in made:
        assert "10.20.30.40" not in (r["sanitized_text"] or "") and "@" not in (r["sanitized_text"] or "")
        if r["text"]:
            assert r["final_text"] == f"[mock-model] {r['text']}"


def test_columns_of_the_caller_come_back(spark):
    frame = spark.createDataFrame([("t", "c", "h", 1, "en", "mail a@x.org")], MESSAGE)
    odd = ["spans", "locale", "_0", "_m", "_row", "_tokens", "_parts", "_out", "_lang", "_c0", "a.b", "trace"]
    frame = frame.select("*", *[F.lit(n).alias(c) for n, c in enumerate(odd)])
    made = Firewall.create().anonymize(frame).messages
    r = made.first()
    assert made.columns == [c for c in frame.columns if c != "trace"] + ["sanitized_text", "trace"]
    assert [r[c] for c in odd[:-1]] == list(range(len(odd) - 1)) and r["sanitized_text"] == "mail [EMAIL_001]"


def test_empty_tables_and_plain_texts(spark):
    assert Firewall.create().anonymize(spark.createDataFrame([], MESSAGE)).messages.count() == 0
    made = Firewall.create().anonymize(spark.createDataFrame([("t", "c", "h", 1, "en", "nothing")], MESSAGE))
    assert made.vault.count() == 0 and made.registry.count() == 0 and made.messages.first()["sanitized_text"] == "nothing"


def test_characters_on_which_java_and_python_differ(spark):
    seeds = ["a@b.org", "10.0.0.1", "612345678", "12345678A", "123-45-6789", "4111 1111 1111 1111"]
    marks = ["́", "ः", "½", "Ⅳ", "\x1c", "\U0001f600", "\U0001d400", "\U0001d7cf", "٣", " "]
    rows = [(m + s + n, "ES") for s in seeds for m in marks for n in marks]
    found = spark.createDataFrame(rows, "text string, locale string").withColumn("s", spans.detect(Catalog.default())).collect()
    for r in found:
        want = sorted((a, b, t, p.entity_type) for p in Catalog.default().for_locale("ES") for t, a, b in p.match(r["text"]))
        assert sorted((s["start"], s["end"], s["text"], s["entity_type"]) for s in r["s"]) == want
    assert spelled_out(r"[\w.]\d\[\b") == "[\\p{L}\\p{N}_.]\\p{Nd}\\[" + spelled_out(r"\b")


def test_very_large_payloads_keep_their_places(spark):
    rows = spark.sql("select 't' as tenant_id, 'c' as case_id, 'h' as thread_id, 9000000000000000000 as msg_seq, transform(sequence(1, 120000), i -> if(i % 50000 = 1, concat('m', i, '@x.org'), 'plain')) as p union all select null, null, null, 1, array('a@b.org', null)")
    done, _ = Firewall.create(language="en").anonymize_payload(rows, "p")
    got = {r["tenant_id"]: r["p"] for r in done.collect()}
    assert len(got["t"]) == 120000 and [x for x in got["t"] if x != "plain"] == ["[EMAIL_001]", "[EMAIL_002]", "[EMAIL_003]"]
    assert got[None] == ["[EMAIL_001]", None]


# tokens over runs, time to live, detectors


def test_persons_of_an_earlier_registry_keep_their_tokens(spark):
    def find(_, texts):
        return [[(m.start(), m.end(), "PER", 0.99) for m in re.finditer("Ana García|Emma Wilson|A. García|Li Wu", t)] for t in texts]

    wall = Firewall.create(language="es", plugins=[backends.SpanPlugin("fake", find)])
    first = wall.anonymize(spark.createDataFrame([("t", "c", "h", 1, None, "Ana García ve a Emma Wilson, a@x.org")], MESSAGE))
    assert first.messages.first()["sanitized_text"] == "[PERSON_002] ve a [PERSON_001], [EMAIL_001]"
    second = wall.anonymize(spark.createDataFrame([("t", "c", "h", 2, None, "Li Wu ve a A. García, b@x.org"), (None, "c", "h", 2, None, "Li Wu")], MESSAGE), registry=first.registry)
    got = {r["tenant_id"]: r["sanitized_text"] for r in second.messages.collect()}
    assert got == {"t": "[PERSON_003] ve a [PERSON_002], [EMAIL_002]", None: "[PERSON_001]"}
    told = sorted((r["tenant_id"] or "", r["token"]) for r in second.registry.collect())
    assert told == [("", "[PERSON_001]"), ("t", "[EMAIL_001]"), ("t", "[EMAIL_002]"), ("t", "[PERSON_001]"), ("t", "[PERSON_002]"), ("t", "[PERSON_003]")]


def test_unknown_actions_are_pseudonyms():
    profile = Profile.from_dict({"name": "x", "dispositions": {"EMAIL": {"action": "explode"}}})
    assert profile.get("EMAIL").action == "pseudonymize"
    with pytest.raises(ValueError):
        Disposition("EMAIL", "explode")


def test_time_to_live_by_disposition(spark):
    profile = Profile("p", {"EMAIL": Disposition("EMAIL", parameters={"ttl_seconds": 5}), "IP_ADDRESS": Disposition("IP_ADDRESS", parameters={"ttl_seconds": None})})
    made = Firewall.create(profile=profile).anonymize(spark.createDataFrame([("t", "c", "h", 1, "en", "a@x.org 10.0.0.1")], MESSAGE), now=100)
    assert {r["token"]: r["expires_at"] for r in made.vault.collect()} == {"[EMAIL_001]": 105, "[IP_ADDRESS_001]": None}


def test_detectors_come_and_go():
    wall = Firewall.create()
    wall.add_regex("TICKET", r"\bTCK-\d+\b")
    assert "TICKET:GLOBAL" in wall.detectors() and "TICKET" in wall.supported_entities()
    assert wall.remove_detector("TICKET:GLOBAL") == 1 and "TICKET" not in wall.supported_entities() and wall.remove_detector("none") == 0


# languages


def test_thread_languages_in_order(spark):
    rows = [("a", 1, None, "es", 0.2, 0), ("a", 2, None, "fr", 0.6, 1), ("a", 3, "de", "it", 0.9, 2), ("a", 4, None, "fr", 0.7, 3), ("a", 5, None, "es", 0.1, 4), ("a", 6, None, "it", 0.1, 9000), ("b", 1, None, None, 0.0, 0), (None, 1, None, "pt", 0.1, 0)]
    frame = spark.createDataFrame(rows, "thread string, seq int, lang string, detected string, confidence double, at long")
    got = {(r["thread"], r["seq"]): r["language"] for r in languages.resolve_languages(frame, ["thread"], ["seq"], "at").collect()}
    assert got == {("a", 1): "es", ("a", 2): "es", ("a", 3): "de", ("a", 4): "fr", ("a", 5): "fr", ("a", 6): "it", ("b", 1): "en", (None, 1): "pt"}
    kept, gone = languages.purge_languages(spark.sql("select 1 as set_at union all select 9000"), 9100)
    assert kept.count() == 1 and gone.first()["purged"] == 1


def test_detectors_by_name(spark):
    with pytest.raises(ValueError):
        languages.create_detector("planet")
    for name in ("langdetect", "fasttext"):  # not on this machine
        with pytest.raises(ImportError):
            languages.create_detector(name, "model.bin")
    found = languages.Detector(lambda _, t: ("es", 0.9)).add_language(spark.createDataFrame([("hola",), ("hola amigos todos",), (None,)], "text string")).collect()
    assert sorted((r["detected"], r["confidence"]) for r in found) == [("en", 0.0), ("en", 0.0), ("es", 0.9)]


# models


def test_models_by_domain_and_language():
    assert models.find_model("general", "fr").model_id == "Jean-Baptiste/camembert-ner"
    with pytest.warns(UserWarning):
        assert models.find_model("general", "pt").language == "multilingual"
    with pytest.warns(UserWarning):
        assert models.find_model("medical", "es").language == "en"
    with pytest.raises(ValueError):
        models.find_model("legal", "en")
    assert models.domain_of("d4data/biomedical-ner-all") == "medical" and models.domain_of("own") == "general"
    assert len(models.list_models()) == 6 and len(models.list_models("general")) == 5 and len(models.list_models("general", "de")) == 1


def test_engine_selection():
    chosen = lambda *a, **k: [(e.model_id, e.domain, e.url) for e in models.select_engines(*a, **k)]
    bio = ("d4data/biomedical-ner-all", "medical", None)
    assert chosen(["EMAIL"]) == [("dslim/bert-base-NER", "general", None)] and chosen(["EMAIL"], backend="presidio") == []
    assert chosen(["DRUG"], backend="presidio") == [bio] and chosen(["DRUG"])[1] == bio
    assert chosen(["DRUG"], model_ids=["x", bio[0], "x"]) == [("x", "general", None), bio] and chosen(["DRUG"], model_ids=[]) == []
    assert chosen(["DRUG"], model_id="y", remote=True, url="http://u") == [("y", "general", "http://u")]
    with pytest.raises(ValueError):
        chosen(["DRUG"], remote=True)


def test_remote_models(spark):
    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            at = asked["text"].find("Ana")
            items = [{"entity_group": "PER", "start": at, "end": at + 3, "score": 0.9}] if at >= 0 else []
            body = b"oops" if "break" in asked["text"] else json.dumps({"predictions": items}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    wall = Firewall.create(plugins=[remote_plugin(url, "m")])
    rows = spark.createDataFrame([("t", "c", "h", 1, "en", "so Ana said"), ("t", "c", "h", 2, "en", "none")], MESSAGE)
    assert sorted(r["sanitized_text"] for r in wall.anonymize(rows).messages.collect()) == ["none", "so [PERSON_001] said"]
    with pytest.raises(RuntimeError):
        ask(url, "m", "break")
    server.shutdown()
    with pytest.raises(RuntimeError):
        ask("http://127.0.0.1:9", "m", "x", timeout=0.5)
    with pytest.raises(ValueError):
        remote_plugin("", "m")


# parts of speech

_KINDS = {"compare": "VERB", "came": "VERB", "is": "AUX", "the": "DET", "also": "ADV", "with": "ADP", "dr": "NOUN", "blue": "ADJ", "house": "NOUN"}


def _tagging(kinds=_KINDS):
    def tag(_, text):
        out = []
        for m in re.finditer(r"\w+|[^\w\s]", text):
            kind = kinds.get(m[0].lower()) or ("PROPN" if m[0][0].isupper() else "NOUN") if m[0][0].isalnum() else "PUNCT"
            out.append(Word(m.start(), m.end(), m[0], kind))
        return out

    return tag


_tag = _tagging()


def test_names_by_parts_of_speech():
    part = lambda text: text[slice(*trimmed(_tag(None, text)))]
    assert part("with Ana García came") == "Ana García" and part("also Dr Ruiz") == "Dr Ruiz" and part("patient Ana G.") == "Ana G."
    assert trimmed(_tag(None, "with the")) is None
    good = lambda text: like_a_name(text, _tag(None, text))
    assert good("Ana García") and good("Ana G.") and not good("the house") and not good("Ana, Bob") and not good("blue house") and not good("")


def test_tagger_in_the_pipeline(spark):
    def find(_, texts):
        return [[(m.start(), m.end(), "PER", 0.9) for m in re.finditer("with Ana Ruiz|Compare Bob Lee|the house|Eve Fox", t)] for t in texts]

    wall = Firewall.create(plugins=[backends.SpanPlugin("fake", find)], tagger=Tagger(_tagging()))
    rows = spark.createDataFrame([("t", "c", "h", 1, "en", "he met with Ana Ruiz near the house"), ("t", "c", "h", 2, "en", "we came Eve Fox")], MESSAGE)
    got = [r["sanitized_text"] for r in wall.anonymize(rows).messages.orderBy("msg_seq").collect()]
    assert got == ["he met with [PERSON_001] near the house", "we came Eve Fox"]


# reversible operators


def test_encrypted_spans_come_back(spark):
    spanned = f"cast(array(struct(0 as start, 0 as ord, 3 as end, 'Ann' as text, 'PERSON' as entity_type, 0.9D as confidence, 'x' as source), struct(9 as start, 1 as ord, 16 as end, 'a@x.org' as text, 'EMAIL' as entity_type, 1D as confidence, 'x' as source), struct(17 as start, 2 as ord, 21 as end, '4242' as text, 'CARD' as entity_type, 1D as confidence, 'x' as source), struct(22 as start, 3 as ord, 25 as end, 'pin' as text, 'SECRET' as entity_type, 1D as confidence, 'x' as source)) as {SPANS_SQL})"
    rows = spark.sql(f"select 'Ann mail a@x.org 4242 pin' as text, {spanned} as spans union all select null, null union all select 'x', cast(array() as {SPANS_SQL})")
    done = apply_operators(rows, {"PERSON": ("encrypt", {"key": "k" * 16}), "EMAIL": ("encrypt", {"key": "k" * 16}), "CARD": ("mask", {"chars_to_mask": 2}), "SECRET": ("redact", {})})
    got = {r["text"]: r for r in done.withColumn("back", deanonymize(F.col("anonymized"), F.col("items"), "k" * 16)).collect()}
    one = got["Ann mail a@x.org 4242 pin"]
    assert one["back"] == "Ann mail a@x.org **42 " and "Ann" not in one["anonymized"].split(" mail")[0]
    assert [one["anonymized"][i["start"] : i["end"]] for i in one["items"]] == [i["text"] for i in one["items"]]
    assert got["x"]["anonymized"] == "x" and got[None]["anonymized"] is None
    hashed = apply_operators(rows.where("text like 'Ann%'"), {"DEFAULT": ("hash", {}), "CARD": ("keep", {}), "EMAIL": ("replace", {"new_value": "M"})}).first()["anonymized"]
    assert hashed == f"{hashlib.sha256(b'Ann').hexdigest()} mail M 4242 {hashlib.sha256(b'pin').hexdigest()}"
    with pytest.raises(ValueError):
        apply_operators(rows, {"PERSON": ("encrypt", {"key": "short"})})
    with pytest.raises(ValueError):
        apply_operators(rows, {"PERSON": ("burn", {})})


# facade


def test_facade(spark, tmp_path):
    now = [1000]
    sdk = Sdk(spark, Firewall.create(language="en"), f"file://{tmp_path}/sdk", clock=lambda: now[0])
    ctx = {"tenant_id": "t", "case_id": "c", "thread_id": "h"}
    assert sdk.anonymize_text("mail a@x.org", ctx)["sanitized_text"] == "mail [EMAIL_001]"
    assert sdk.secure_call("b@x.org and a@x.org", ctx, lambda p: f"hi {p}")["final_text"] == "hi b@x.org and a@x.org"
    assert sdk.get_mapping(ctx) == {"[EMAIL_001]": "a@x.org", "[EMAIL_002]": "b@x.org"}
    pieces = list(sdk.secure_call_stream("a@x.org", ctx, lambda p: [f"to {p[:4]}", p[4:], "!"]))
    assert "".join(pieces) == "to a@x.org!" and not any("[EM" in p for p in pieces)
    payload = sdk.anonymize_payload({"to": ["c@x.org", 3], "n": None}, ctx)
    assert payload == {"to": ["[EMAIL_003]", 3], "n": None} and sdk.rehydrate_payload(payload, ctx) == {"to": ["c@x.org", 3], "n": None}
    with pytest.raises(ValueError, match="thread_id"):
        sdk.anonymize_text("x", {"tenant_id": "t", "case_id": "c"})
    assert sdk.forget("t", "c", "h") == 3 and sdk.get_mapping(ctx) == {} and sdk.rehydrate_text("[EMAIL_001]", ctx) == "[EMAIL_001]"


def test_model_answers_in_chunks(spark):
    rows = spark.createDataFrame([("t", "c", "h", 1, "en", "mail a@x.org")], MESSAGE)
    chunks = lambda m: m.select("tenant_id", "case_id", "thread_id", F.posexplode(F.array(F.lit("to [EMA"), F.lit("IL_001] now"))).alias("chunk_seq", "chunk"))
    _, out = Firewall.create().secure_call_stream(rows, chunks)
    assert out.first()["final_text"] == "to a@x.org now"


def test_prompts_of_a_source_file():
    source = 'export const P: Record<string, string[]> = {\n  es: [\n    "uno \\"dos\\"",\n    "tres\\ncuatro",\n  ],\n  en: [\n    "one [x], two",\n  ],\n};'
    assert parse_prompts(source) == [("es", 0, 'uno "dos"'), ("es", 1, "tres\ncuatro"), ("en", 0, "one [x], two")]


def test_numbering_of_null_keys(spark):
    rows = [(None, None, "h", i, 0, "EMAIL", f"{i}@x.org") for i in range(3)]
    m = spark.createDataFrame(rows, "tenant_id string, case_id string, thread_id string, msg_seq long, start int, entity_type string, text string")
    made = tokens.resolve_exact(m, "case")
    assert sorted(r["ordinal"] for r in made.collect()) == [1, 2, 3]
    more = tokens.resolve_exact(m, "case", made)
    assert more.count() == 3
