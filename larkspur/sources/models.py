"""Named-entity models by domain and language, and which of them a profile needs."""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from dataclasses import dataclass

from larkspur.sources.languages import required_domains


@dataclass(frozen=True)
class Model:
    model_id: str
    domain: str
    language: str
    labels: tuple[str, ...]
    size_mb: int


# Known models: id, domain, language, labels, size in MB.
MODELS = [
    Model("dslim/bert-base-NER", "general", "en", ("PERSON", "ORGANIZATION", "LOCATION", "MISC"), 420),
    Model("Davlan/xlm-roberta-base-ner-hrl", "general", "es", ("PERSON", "ORGANIZATION", "LOCATION", "MISC"), 1100),
    Model("Jean-Baptiste/camembert-ner", "general", "fr", ("PERSON", "ORGANIZATION", "LOCATION"), 440),
    Model("dslim/bert-base-NER-uncased", "general", "de", ("PERSON", "ORGANIZATION", "LOCATION", "MISC"), 420),
    Model("Davlan/xlm-roberta-base-ner-hrl", "general", "multilingual", ("PERSON", "ORGANIZATION", "LOCATION"), 1100),
    Model("d4data/biomedical-ner-all", "medical", "en", ("Disease_disorder", "Sign_symptom", "Medication", "Diagnostic_procedure", "Therapeutic_procedure", "Lab_value", "Biological_structure", "Clinical_event"), 265),
]


def find_model(domain: str, language: str) -> Model:
    """The model of a domain for a language; failing that, with a warning, the one for many languages or English."""
    own = {m.language: m for m in MODELS if m.domain == domain}
    best = next((x for x in (language, "multilingual", "en") if x in own), None)
    if best is None:
        raise ValueError(f"no model for the domain {domain!r} and the language {language!r}")
    if best != language:
        warnings.warn(f"no {language} model for the domain {domain!r}: taking the one for {best}", stacklevel=2)
    return own[best]


def domain_of(model_id: str) -> str:
    """The domain of a known model; general for others."""
    return {m.model_id: m.domain for m in reversed(MODELS)}.get(model_id, "general")


def list_models(domain: str | None = None, language: str | None = None) -> list[Model]:
    return [m for m in MODELS if domain in (None, m.domain) and language in (None, m.language)]


@dataclass(frozen=True)
class Engine:
    """A model to run: here or behind a URL; domain says how its labels are read."""

    model_id: str
    domain: str
    url: str | None = None


def select_engines(types: Iterable[str], language: str = "en", backend: str = "hybrid", model_ids: list[str] | None = None, model_id: str | None = None, remote: bool = False, url: str | None = None) -> list[Engine]:
    """The models that a firewall runs, each once.

    A list of ids is taken as it is, with the domains that are known for them; a single id is a general model.
    Otherwise there is a model for each domain that the types ask for, and a general one unless presidio runs. A
    domain without a model is left out with a warning. Remote models need a URL.
    """
    if remote and not url:
        raise ValueError("remote models need a URL")
    where = url if remote else None
    if model_ids is not None:
        return [Engine(m, domain_of(m), where) for m in dict.fromkeys(model_ids)]
    if model_id:
        return [Engine(model_id, "general", where)]
    chosen: dict[str, Engine] = {}
    for domain in sorted(required_domains(types) | (set() if backend == "presidio" else {"general"})):
        try:
            found = find_model(domain, language)
        except ValueError as error:
            warnings.warn(f"{error}: left out", stacklevel=2)
            continue
        chosen.setdefault(found.model_id, Engine(found.model_id, domain, where))
    return list(chosen.values())
