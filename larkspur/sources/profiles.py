"""What a domain does with each entity type, and the preset domains."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

ACTIONS = ["keep", "pseudonymize", "generalize", "mask", "hash", "redact"]
SCOPES = ["thread", "case", "tenant"]
THRESHOLD = 0.75

# Fixed values of the presets: thresholds and actions by type; "=" in a domain's table is left to the base.
_PLAIN = "EMAIL NATIONAL_ID SSN IBAN ACCOUNT_NUMBER TAX_ID ADDRESS POSTAL_CODE IP_ADDRESS URL SECRET PASSPORT DRIVERS_LICENSE MAC_ADDRESS ROUTING_NUMBER".split()
BASE: dict[str, tuple[str, float, dict[str, Any]]] = {
    "PERSON": ("pseudonymize", 0.75, {}),
    "PHONE_NUMBER": ("pseudonymize", 0.35, {}),
    **{name: ("pseudonymize", 0.75, {}) for name in _PLAIN},
    "CREDIT_CARD": ("mask", 0.75, {"visible_end": 4}),
    "LOCATION": ("generalize", 0.75, {"level": "city"}),
    "DATE": ("generalize", 0.75, {"granularity": "year"}),
    "DATE_TIME": ("generalize", 0.55, {"granularity": "year"}),
    "AGE": ("generalize", 0.75, {"bucket_size": 10}),
}
_MEDICAL = "DIAGNOSIS DRUG PROCEDURE SYMPTOM".split()
PRESETS: dict[str, tuple[float, dict[str, tuple[str, float, dict[str, Any]]]]] = {
    "generic": (0.75, {n: ("pseudonymize", 0.75, {}) for n in [*_MEDICAL, "MEDICAL_RECORD"]}),
    "healthcare": (
        0.80,
        {
            "PERSON": ("pseudonymize", 0.80, {}),
            "CREDIT_CARD": ("pseudonymize", 0.75, {}),
            **{n: ("keep", 0.75, {}) for n in [*_MEDICAL, "LAB_VALUE", "VITAL_SIGN", "DOI", "PMID"]},
            "MEDICAL_RECORD": ("pseudonymize", 0.75, {}),
        },
    ),
    "finance": (
        0.75,
        {
            "DATE": ("keep", 0.75, {}),
            "DATE_TIME": ("generalize", 0.75, {"granularity": "year"}),
            **{n: ("pseudonymize", 0.45, {}) for n in _MEDICAL},
            "MEDICAL_RECORD": ("pseudonymize", 0.75, {}),
            "COMPANY_NAME": ("keep", 0.75, {}),
        },
    ),
    "legal": (
        0.85,
        {
            "PERSON": ("pseudonymize", 0.85, {}),
            "CREDIT_CARD": ("pseudonymize", 0.75, {}),
            "DATE": ("generalize", 0.75, {"granularity": "month"}),
            "DATE_TIME": ("generalize", 0.55, {"granularity": "month"}),
            **{n: ("pseudonymize", 0.45, {}) for n in _MEDICAL},
            "MEDICAL_RECORD": ("pseudonymize", 0.75, {}),
            "COMPANY_NAME": ("keep", 0.75, {}),
        },
    ),
}


@dataclass(frozen=True)
class Disposition:
    """What happens to spans of a type from a confidence on. parameters of pseudonyms: ttl_seconds, none or 0 for ever."""

    entity_type: str
    action: str = "pseudonymize"
    confidence_threshold: float = THRESHOLD
    parameters: dict[str, Any] = field(default_factory=dict)
    description: str = ""

    def __post_init__(self):
        if self.action not in ACTIONS:
            raise ValueError(f"unknown action {self.action!r}; it is one of {', '.join(ACTIONS)}")

    def should_process(self, confidence: float) -> bool:
        return confidence >= self.confidence_threshold


@dataclass
class Profile:
    """A domain: a disposition for each type; types without one are left in the text."""

    name: str
    dispositions: dict[str, Disposition] = field(default_factory=dict)
    defensive_cleanup: bool = True
    token_scope: str = "tenant"
    similarity_threshold: float = 0.75
    linguistic_filter: bool = True
    description: str = ""

    def __post_init__(self):
        if self.token_scope not in SCOPES:
            raise ValueError(f"unknown token scope {self.token_scope!r}; it is one of {', '.join(SCOPES)}")

    def get(self, entity_type: str) -> Disposition | None:
        return self.dispositions.get(entity_type)

    def add(self, disposition: Disposition) -> None:
        self.dispositions[disposition.entity_type] = disposition

    def _does(self, entity_type: str, action: str) -> bool:
        found = self.get(entity_type)
        return found is not None and found.action == action

    def should_keep(self, entity_type: str) -> bool:
        return self._does(entity_type, "keep")

    def should_redact(self, entity_type: str) -> bool:
        return self._does(entity_type, "redact")

    def should_pseudonymize(self, entity_type: str) -> bool:
        return self._does(entity_type, "pseudonymize")

    def kept_entities(self) -> list[str]:
        return [t for t in self.dispositions if self.should_keep(t)]

    def sensitive_entities(self) -> list[str]:
        return [t for t in self.dispositions if not self.should_keep(t)]

    def rows(self) -> list[tuple[str, str, str, float, dict[str, str]]]:
        """(profile, entity_type, action, confidence_threshold, parameters) for a DataFrame."""
        return [(self.name, d.entity_type, d.action, d.confidence_threshold, {k: str(v) for k, v in d.parameters.items()}) for d in self.dispositions.values()]

    @classmethod
    def from_dict(cls, config: dict[str, Any]) -> Profile:
        # an action that isn't known is the safe one: a pseudonym
        acts = {t: d.get("action", "pseudonymize") for t, d in config.get("dispositions", {}).items()}
        own = {t: Disposition(t, acts[t] if acts[t] in ACTIONS else "pseudonymize", float(d.get("confidence_threshold", THRESHOLD)), dict(d.get("parameters") or {}), d.get("description", "")) for t, d in config.get("dispositions", {}).items()}
        rest = {k: config[k] for k in ("defensive_cleanup", "token_scope", "similarity_threshold", "linguistic_filter", "description") if k in config}
        return cls(config["name"], own, **rest)

    def to_dict(self) -> dict[str, Any]:
        own = {t: {"action": d.action, "confidence_threshold": d.confidence_threshold, "parameters": dict(d.parameters), "description": d.description} for t, d in self.dispositions.items()}
        return {"name": self.name, "dispositions": own, "defensive_cleanup": self.defensive_cleanup, "token_scope": self.token_scope, "similarity_threshold": self.similarity_threshold, "linguistic_filter": self.linguistic_filter, "description": self.description}


def preset_names() -> list[str]:
    return list(PRESETS)


def preset(name: str) -> Profile:
    """A fresh copy of a preset domain."""
    if name not in PRESETS:
        raise ValueError(f"unknown profile {name!r}; there are {', '.join(PRESETS)}")
    similarity, own = PRESETS[name]
    table = BASE | own
    return Profile(name, {t: Disposition(t, a, c, dict(p)) for t, (a, c, p) in table.items()}, similarity_threshold=similarity)


def custom_profile(name: str, base: Profile | None = None, **changes: Any) -> Profile:
    """A profile from a base (the generic one), with other dispositions or settings; dispositions are merged."""
    made = Profile.from_dict((base or preset("generic")).to_dict() | {"name": name})
    for d in changes.pop("dispositions", {}).values():
        made.add(d)
    for key, value in changes.items():
        if not hasattr(made, key):
            raise ValueError(f"a profile has no setting {key!r}")
        setattr(made, key, value)
    made.__post_init__()
    return made
