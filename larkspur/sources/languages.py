"""Languages, their locales, and the models that named-entity plug-ins use for them."""

from __future__ import annotations

from dataclasses import dataclass

# Language code to pattern locale; other languages go to xx.
LOCALES = {"es": "ES", "en": "US", "fr": "FR", "de": "DE", "it": "IT", "pt": "PT", "nl": "NL", "ca": "ES", "xx": "GLOBAL"}
FALLBACK = "en"
#: A language that a detector is less sure of than this doesn't replace the one that a thread had.
SWITCH_CONFIDENCE = 0.70
CACHE_SECONDS = 3600
#: Entity types that need a plug-in for medical texts.
MEDICAL_TYPES = {"DIAGNOSIS", "DRUG", "PROCEDURE", "LAB_VALUE", "VITAL_SIGN", "SYMPTOM", "ANATOMICAL_SITE"}


@dataclass(frozen=True)
class Language:
    code: str
    locale: str
    pos_tags: bool = False


class Router:
    """Languages by code; an unknown one is the fallback for all."""

    def __init__(self):
        self.known = {code: Language(code, locale) for code, locale in LOCALES.items()}

    def get(self, code: str) -> Language:
        return self.known.get(code, self.known["xx"])

    def locale_of(self, code: str) -> str:
        return self.get(code).locale

    def add(self, language: Language) -> None:
        self.known[language.code] = language

    def locale_sql(self, column: str = "lang") -> str:
        """SQL for the locale of a language column; a missing language is English."""
        cases = " ".join(f"when '{c}' then '{x.locale}'" for c, x in self.known.items())
        return f"(case coalesce({column}, '{FALLBACK}') {cases} else '{self.known['xx'].locale}' end)"


def required_domains(entity_types) -> set[str]:
    """Domains of models that a profile's types ask for."""
    return {"medical"} if MEDICAL_TYPES & set(entity_types) else set()
