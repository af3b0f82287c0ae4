"""Other detectors: labels of models, ready expressions of recognisers, plug-ins, and answers of remote models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.sources.catalog import Catalog, Pattern
from larkspur.sources.entities import SPANS_SQL

# Labels of models and the types that they stand for.
OPF = {
    "private_person": "PERSON", "private_email": "EMAIL", "private_phone": "PHONE_NUMBER", "private_date": "DATE_TIME",
    "private_address": "ADDRESS", "private_url": "URL", "account_number": "ACCOUNT_NUMBER", "secret": "SECRET",
}
GLINER = {
    "name": "PERSON", "first name": "PERSON", "last name": "PERSON", "email address": "EMAIL", "phone number": "PHONE_NUMBER",
    "location address": "ADDRESS", "location city": "LOCATION", "location state": "LOCATION", "location country": "LOCATION",
    "location zip": "POSTAL_CODE", "dob": "DATE_TIME", "date of birth": "DATE_TIME", "date": "DATE_TIME", "passport number": "PASSPORT",
    "driver license": "DRIVERS_LICENSE", "ssn": "SSN", "national id": "NATIONAL_ID", "tax id": "TAX_ID",
    "medical record number": "MEDICAL_RECORD", "healthcare number": "MEDICAL_RECORD", "account number": "ACCOUNT_NUMBER",
    "bank account": "ACCOUNT_NUMBER", "routing number": "ROUTING_NUMBER", "credit card": "CREDIT_CARD", "url": "URL",
    "ip address": "IP_ADDRESS", "username": "SECRET", "password": "SECRET", "api key": "SECRET",
}
NEMOTRON = OPF | {
    "first_name": "PERSON", "last_name": "PERSON", "user_name": "SECRET", "email": "EMAIL", "phone_number": "PHONE_NUMBER",
    "fax_number": "PHONE_NUMBER", "url": "URL", "street_address": "ADDRESS", "city": "LOCATION", "county": "LOCATION",
    "state": "LOCATION", "country": "LOCATION", "postcode": "POSTAL_CODE", "date": "DATE_TIME", "date_of_birth": "DATE_TIME",
    "date_time": "DATE_TIME", "time": "DATE_TIME", "ssn": "SSN", "national_id": "NATIONAL_ID", "tax_id": "TAX_ID",
    "credit_debit_card": "CREDIT_CARD", "bank_routing_number": "ACCOUNT_NUMBER", "swift_bic": "ACCOUNT_NUMBER", "cvv": "SECRET",
    "pin": "SECRET", "password": "SECRET", "medical_record_number": "MEDICAL_RECORD", "health_plan_beneficiary_number": "MEDICAL_RECORD",
    "customer_id": "NATIONAL_ID", "employee_id": "NATIONAL_ID", "unique_id": "NATIONAL_ID", "certificate_license_number": "NATIONAL_ID",
    "license_plate": "LICENSE_PLATE", "vehicle_identifier": "NATIONAL_ID", "ipv4": "IP_ADDRESS", "ipv6": "IP_ADDRESS",
    "mac_address": "MAC_ADDRESS", "device_identifier": "NATIONAL_ID", "api_key": "SECRET", "http_cookie": "SECRET",
}
CONLL = {"PER": "PERSON", "PERSON": "PERSON", "ORG": "COMPANY_NAME", "ORGANIZATION": "COMPANY_NAME", "LOC": "LOCATION", "LOCATION": "LOCATION", "GPE": "LOCATION"}
MEDICAL = {
    "DISEASE_DISORDER": "DIAGNOSIS", "SIGN_SYMPTOM": "SYMPTOM", "MEDICATION": "DRUG", "DIAGNOSTIC_PROCEDURE": "PROCEDURE",
    "THERAPEUTIC_PROCEDURE": "PROCEDURE", "LAB_VALUE": "LAB_VALUE", "BIOLOGICAL_STRUCTURE": "ANATOMICAL_SITE",
    "FAMILY_HISTORY": "DIAGNOSIS", "DOSAGE": "DRUG", "HISTORY": "DIAGNOSIS", "DISEASE": "DIAGNOSIS", "DISORDER": "DIAGNOSIS",
    "SYMPTOM": "SYMPTOM", "CHEMICAL": "DRUG", "DRUG": "DRUG", "PROCEDURE": "PROCEDURE", "ANATOMY": "ANATOMICAL_SITE",
    "GENE": "DIAGNOSIS", "PROTEIN": "DIAGNOSIS",
}
MEDICAL_DROPPED = ["AGE", "TIME", "DATE", "SEVERITY", "CLINICAL_EVENT", "ACTIVITY", "OUTCOME"]
LABELS = {"opf": OPF, "gliner": GLINER, "nemotron": NEMOTRON, "conll": CONLL, "medical": MEDICAL}
BACKENDS = ["regex", "presidio", "hybrid", "opf", "gliner", "nemotron", "transformers"]

# Expressions of the recognisers for all languages and for Spanish: type, confidence, expression; context words by type.
_MONTHS_ES = "enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"
UNIVERSAL = [
    ("PHONE_NUMBER", 0.95, r"\+\d{1,3}\s?\d{9,10}\b"),
    ("PHONE_NUMBER", 0.90, r"\+\d{1,3}\s?\d{3}\s?\d{3}\s?\d{3,4}\b"),
    ("PHONE_NUMBER", 0.85, r"\+?1?\s?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{4}\b"),
    ("DATE_TIME", 0.95, r"\b\d{4}-(0?[1-9]|1[0-2])-(0?[1-9]|[12][0-9]|3[01])\b"),
    ("DATE_TIME", 0.85, r"\b(0?[1-9]|[12][0-9]|3[01])/(0?[1-9]|1[0-2])/\d{4}\b"),
    ("DATE_TIME", 0.85, r"\b(0?[1-9]|[12][0-9]|3[01])-(0?[1-9]|1[0-2])-\d{4}\b"),
    ("DATE_TIME", 0.75, r"\b(0?[1-9]|1[0-2])/(0?[1-9]|[12][0-9]|3[01])/\d{4}\b"),
    ("PERSON", 0.95, r"\b[A-Z][a-z]+\s+[A-Z]\."),
    ("PERSON", 0.95, r"\b[A-Z]\.\s+[A-Z][a-z]+\b"),
    ("PERSON", 0.95, r"\b[A-Z][a-z]+\s+[A-Z]\.\s+[A-Z][a-z]+\b"),
    ("PERSON", 0.95, r"\b[A-Z]\.\s+[A-Z]\.\s+[A-Z][a-z]+\b"),
]
SPANISH = [
    ("NATIONAL_ID", 0.99, r"\b\d{8}[A-HJ-NP-TV-Z]\b"),
    ("NATIONAL_ID", 0.99, r"\b\d{8}-[A-HJ-NP-TV-Z]\b"),
    ("NATIONAL_ID", 0.95, r"\b\d{2}\s?\d{3}\s?\d{3}\s?[A-HJ-NP-TV-Z]\b"),
    ("IBAN", 0.95, r"\bES\d{22}\b"),
    ("IBAN", 0.95, r"\bES\d{2}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\b"),
    ("IBAN", 0.85, r"\b[A-Z]{2}\d{2}[A-Z0-9]{12,30}\b"),
    ("PHONE_NUMBER", 0.80, r"\b[67]\d{2}\s?\d{3}\s?\d{3}\b"),
    ("PHONE_NUMBER", 0.75, r"\b[89]\d{2}\s?\d{3}\s?\d{3}\b"),
    ("DATE_TIME", 0.95, rf"\b\d{{1,2}}\s+de\s+(?:{_MONTHS_ES})\s+de\s+\d{{4}}\b"),
    ("DATE_TIME", 0.90, rf"\b\d{{1,2}}\s+(?:{_MONTHS_ES})\s+\d{{4}}\b"),
    ("PERSON", 0.90, r"\b(?:María|Sofía|Carmen|Ana|Isabel|Lucía|Elena|Rosa|Teresa|Pilar)\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+\b"),
    ("PERSON", 0.90, r"\b(?:José|Juan|Antonio|Manuel|Francisco|Pedro|Luis|Carlos|Miguel|Javier)\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+\b"),
    ("PERSON", 0.85, r"\b[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+\s+(?:García|Rodríguez|López|Martínez|Fernández|González|Pérez|Sánchez)\b"),
]


def recognizers(language: str = "en") -> Catalog:
    """The ready recognisers of a language as a catalogue for all locales; they need no model."""
    made = Catalog()
    for entity_type, confidence, regex in UNIVERSAL + (SPANISH if language == "es" else []):
        made.add(Pattern(entity_type, "GLOBAL", regex, confidence))
    return made


def custom_recognizer(entity_type: str, patterns: list[str], context_words: list[str] | None = None, score: float = 0.85) -> list[Pattern]:
    """Patterns of one's own for all locales."""
    return [Pattern(entity_type, "GLOBAL", rx, score, False, tuple(context_words or ())) for rx in patterns]


def map_label(label: Column, backend: str, own: dict[str, str] | None = None) -> Column:
    """The type for a model's label; null: the label is dropped. own: labels of the caller's, applied after the rest."""
    table = LABELS[backend]
    upper = backend in ("conll", "medical")
    key = F.upper(label) if upper else label if backend == "gliner" else F.lower(F.trim(label))
    found = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[key]
    if upper:
        found = F.coalesce(found, key)
    if backend == "medical":
        found = F.when(~key.isin(MEDICAL_DROPPED), found)
    if own:
        found = F.coalesce(F.create_map(*[x for k, v in own.items() for x in (F.lit(k), F.lit(v))])[found], found)
    return found


REMOTE_ITEM = "array<struct<entity_group:string,label:string,word:string,text:string,start:int,end:int,score:double,confidence:double>>"


def remote_spans(response: Column, text: Column, domain: str = "conll", source: str = "remote") -> Column:
    """Spans in the JSON answer of a remote model: a list, or one under predictions or results."""
    inside = F.coalesce(F.get_json_object(response, "$.predictions"), F.get_json_object(response, "$.results"), response)
    listed = F.from_json(inside, REMOTE_ITEM)

    def span(x: Column, i: Column) -> Column:
        kind = map_label(F.coalesce(x["entity_group"], x["label"]), domain)
        own = F.coalesce(x["word"], x["text"], text.substr(x["start"] + 1, x["end"] - x["start"]))
        return F.struct(x["start"].alias("start"), i.alias("ord"), x["end"].alias("end"), own.alias("text"), kind.alias("entity_type"), F.coalesce(x["score"], x["confidence"], F.lit(0.0)).alias("confidence"), F.lit(source).alias("source"))

    good = F.filter(F.transform(listed, span), lambda s: s["entity_type"].isNotNull() & (s["entity_type"] != "") & s["start"].isNotNull() & (s["end"] > s["start"]))
    return F.coalesce(good, F.array()).cast(SPANS_SQL)


@dataclass
class SpanPlugin:
    """A detector in Python: load() runs once in a worker, detect(model, texts) gives (start, end, label, score) lists."""

    name: str
    detect: Callable
    load: Callable = field(default=lambda: None)
    labels: str = "conll"
    threshold: float = 0.0

    def add_spans(self, rows: DataFrame, text: str = "text", out: str = "model_spans") -> DataFrame:
        """The rows with a column of the model's spans, offsets outside the text and unknown labels left out."""
        load, detect, least = self.load, self.detect, self.threshold
        raw = "array<struct<start:int,end:int,label:string,score:double>>"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for batch in batches:
                found = detect(model, batch[text].fillna("").tolist())
                batch[out] = [[{"start": a, "end": b, "label": c, "score": float(d)} for a, b, c, d in spans if d >= least and 0 <= a < b <= len(t)] for spans, t in zip(found, batch[text].fillna(""), strict=True)]
                yield batch

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        made = rows.mapInPandas(run, f"{schema}, `{out}` {raw}")

        def span(x: Column, i: Column) -> Column:
            return F.struct(x["start"].alias("start"), i.alias("ord"), x["end"].alias("end"), F.col(text).substr(x["start"] + 1, x["end"] - x["start"]).alias("text"), map_label(x["label"], self.labels).alias("entity_type"), x["score"].alias("confidence"), F.lit(self.name).alias("source"))

        return made.withColumn(out, F.filter(F.transform(out, span), lambda s: s["entity_type"].isNotNull()).cast(SPANS_SQL))


def merge_backends(*spans: str) -> Column:
    """Spans of several detectors in order of start; on equal starts the earlier detector's first, in its own order."""
    parts = [f"transform({s}, (x, i) -> named_struct('start', x.start, 'ord', i + {k << 24}, 'end', x.end, 'text', x.text, 'entity_type', x.entity_type, 'confidence', x.confidence, 'source', x.source))" for k, s in enumerate(spans)]
    return F.expr(f"array_sort(concat({', '.join(parts)}))")


def check_backend(name: str) -> str:
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name!r}; there are {', '.join(BACKENDS)}")
    return name


#: Label sets of the plug-ins that a back end needs; medical ones come on top if the profile asks for medical types.
NEEDED = {"presidio": ["conll"], "hybrid": ["conll"], "opf": ["opf"], "gliner": ["gliner"], "nemotron": ["nemotron"], "transformers": ["conll"]}
#: Back ends that add the ready recognisers, and those that run medical models.
WITH_RECOGNIZERS = ["presidio", "hybrid"]
WITH_MEDICAL = ["presidio", "hybrid", "transformers"]
MEDICAL_TYPES = {"DIAGNOSIS", "DRUG", "PROCEDURE", "SYMPTOM", "LAB_VALUE", "VITAL_SIGN", "ANATOMICAL_SITE", "MEDICAL_RECORD"}


def missing_models(backend: str, plugins: list[SpanPlugin], types: list[str]) -> list[str]:
    """Label sets that a back end needs for these types and no plug-in has."""
    needed = NEEDED.get(backend, []) + (["medical"] if backend in WITH_MEDICAL and MEDICAL_TYPES & {*types} else [])
    return [n for n in needed if n not in {p.labels for p in plugins}]
