"""Catalogue, profiles, languages and names: what needs no Spark."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from larkspur.functions import names
from larkspur.operators import backends
from larkspur.sources.catalog import Catalog, Pattern, validate_catalog, validate_pattern, validation_report
from larkspur.sources.entities import ENTITY_TYPES, is_known, rank_of, validate
from larkspur.sources.languages import Language, Router, required_domains
from larkspur.sources.profiles import Disposition, Profile, custom_profile, preset, preset_names
from larkspur.streaming.rehydrate import rehydrate_stream


def test_catalogue_has_all_patterns_in_order():
    catalog = Catalog.default()
    assert len(catalog.all()) == 57
    assert [p.description for p in catalog.for_locale("US")][:3] == ["GLOBAL_EMAIL", "GLOBAL_IP_V4", "GLOBAL_IP_V6"]
    assert len(catalog.for_locale("US")) == 23 and len(catalog.for_locale("NL")) == 11
    assert catalog.get("EMAIL", "ES")[0].locale == "GLOBAL" and catalog.get("SSN", "ES")[0].locale == "ES"
    assert "LICENSE_PLATE" in catalog.entity_types("ES") and "LICENSE_PLATE" not in catalog.entity_types("US")


def test_catalogue_survives_dicts_and_removal():
    catalog = Catalog.from_dict(Catalog.default().to_dict())
    assert [p.regex for p in catalog.all()] == [p.regex for p in Catalog.default().all()]
    assert catalog.remove("SSN", "US") == 2 and catalog.remove("SSN", "US") == 0


@pytest.mark.parametrize(
    "text, n",
    [("PMID: 41267587", 1), ("PMID 41267587", 1), ("pmid:41267587", 1), ("Patient ID: 41267587", 0)],
)
def test_pmid(text, n):
    assert len(Catalog.default().get("PMID", "US")[0].match(text)) == n


def test_doi():
    assert Catalog.default().get("DOI", "US")[0].match("See DOI 10.7417/CT.2025.5288 for details.")[0][0] == "10.7417/CT.2025.5288"


@pytest.mark.parametrize(
    "pattern, severity",
    [(Pattern("X", "GLOBAL", "("), "error"), (Pattern("X", "GLOBAL", "a", 2.0), "error"), (Pattern("X", "GLOBAL", "(a*)*"), "warning"), (Pattern("X", "GLOBAL", "a.*.*b"), "warning"), (Pattern("X", "GLOBAL", ".+"), "error"), (Pattern("X", "GLOBAL", "a", 1.0, False, (" ",)), "warning")],
)
def test_checks_find_what_is_wrong(pattern, severity):
    assert severity in {i.severity for i in validate_pattern(pattern)}


def test_default_catalogue_is_valid():
    assert validate_catalog(Catalog.default()) == {} and validation_report({}) == "All patterns are valid."


def test_entity_types():
    assert len(ENTITY_TYPES) == 42 and is_known("EMAIL") and validate("SSN") == "SSN"
    assert rank_of("EMAIL") == 100 and rank_of("PERSON") == 40 and rank_of("AGE") == 10
    with pytest.raises(ValueError):
        validate("NOPE")


def test_presets():
    assert preset_names() == ["generic", "healthcare", "finance", "legal"]
    sizes = {n: len(preset(n).dispositions) for n in preset_names()}
    assert sizes == {"generic": 27, "healthcare": 31, "finance": 28, "legal": 28}
    assert preset("finance").should_keep("DATE") and preset("legal").get("DATE").parameters["granularity"] == "month"
    assert preset("healthcare").should_keep("DOI") and preset("healthcare").get("PERSON").confidence_threshold == 0.80
    with pytest.raises(ValueError):
        preset("nope")
    with pytest.raises(ValueError):
        Disposition("X", "vanish")
    with pytest.raises(ValueError):
        Profile("x", token_scope="planet")


def test_profile_dicts_and_custom():
    p = preset("legal")
    assert Profile.from_dict(p.to_dict()) == p
    own = custom_profile("mine", token_scope="case", dispositions={"AGE": Disposition("AGE", "redact")})
    assert own.should_redact("AGE") and own.token_scope == "case" and "AGE" in own.sensitive_entities()
    with pytest.raises(ValueError):
        custom_profile("mine", colour="red")


def test_router():
    r = Router()
    assert [r.locale_of(x) for x in ("en", "ca", "nl", "zz")] == ["US", "ES", "NL", "GLOBAL"]
    r.add(Language("pl", "PL"))
    assert r.locale_of("pl") == "PL" and required_domains(["DRUG", "AGE"]) == {"medical"} and not required_domains(["AGE"])


@pytest.mark.parametrize(
    "name, expected",
    [("John Smith", "smith"), ("Sarah Smith", "sarah smith"), ("Ana García", "garcía"), ("A. García", "garcía"), ("Dra. Ana García", "garcía"), ("Ana G.", "ana g"), ("John S.", "john s"), ("J.", "")],
)
def test_normalized_names(name, expected):
    assert names.normalize_name(name) == expected


def test_similar_names():
    assert names.similarity("Ana García", "Luis García") == 1.0
    # names are compared in the form in which they are stored
    stored = [names.normalize_name(x) for x in ("Marie Dupont", "Pierre Dupont", "John Smith", "John S.")]
    assert round(names.similarity(stored[0], stored[1]), 3) == 0.692 and names.similarity(stored[2], stored[3]) < 0.75


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_edit_distance_is_a_distance(a, b):
    d = names.edit_distance(a, b)
    assert d == names.edit_distance(b, a) and (d == 0) == (a == b) and abs(len(a) - len(b)) <= d <= max(len(a), len(b))


def test_labels():
    assert backends.GLINER["routing number"] == "ROUTING_NUMBER" and backends.NEMOTRON["mac_address"] == "MAC_ADDRESS"
    assert (len(backends.OPF), len(backends.GLINER), len(backends.NEMOTRON), len(backends.MEDICAL)) == (8, 29, 48, 19)
    assert len(backends.recognizers("en").all()) == 11 and len(backends.recognizers("es").all()) == 24
    with pytest.raises(ValueError):
        backends.check_backend("nope")


@given(st.lists(st.sampled_from(["[EMAIL_001]", "[EMAIL_0012]", "[PER", "SON_001]", "x [", "]", "hello "]), max_size=8), st.integers(1, 7))
def test_streaming_equals_whole_text(parts, size):
    tokens = {"[EMAIL_001]": "a@b.c", "[PERSON_001]": "Ann"}
    text = "".join(parts)
    whole = text
    for t in sorted(tokens, key=len, reverse=True):
        whole = whole.replace(t, tokens[t])
    chunks = [text[i : i + size] for i in range(0, len(text), size)]
    assert "".join(rehydrate_stream(chunks, tokens)) == whole
