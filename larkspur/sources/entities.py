"""Entity types, the span type, and how specific a type is."""

from __future__ import annotations

# Names of entity types.
ENTITY_TYPES = """PERSON EMAIL PHONE_NUMBER URL NATIONAL_ID SSN PASSPORT DRIVERS_LICENSE IBAN CREDIT_CARD ACCOUNT_NUMBER TAX_ID
TRANSACTION_AMOUNT CURRENCY TRANSACTION_TYPE COMPANY_NAME PERCENTAGE DATE_TIME DATE AGE LOCATION ADDRESS POSTAL_CODE
IP_ADDRESS MAC_ADDRESS ROUTING_NUMBER SECRET LICENSE_PLATE MEDICAL_RECORD DIAGNOSIS DRUG PROCEDURE LAB_VALUE VITAL_SIGN
SYMPTOM ANATOMICAL_SITE DOI PMID CASE_NUMBER STATUTE LEGAL_CITATION LEGAL_ENTITY""".split()

# Ranks that decide between overlapping spans; other types have rank 10.
SPECIFICITY = {
    100: "PHONE_NUMBER EMAIL SSN IBAN CREDIT_CARD IP_ADDRESS URL SECRET DOI PMID".split(),
    80: "NATIONAL_ID MEDICAL_RECORD PASSPORT DRIVERS_LICENSE TAX_ID ACCOUNT_NUMBER".split(),
    60: "DATE_TIME DATE".split(),
    40: "PERSON".split(),
    30: "LOCATION ADDRESS POSTAL_CODE".split(),
}
OTHER_RANK = 10

#: Spans sort by start and then by the order in which they were found.
SPAN_SQL = "struct<start:int,ord:int,end:int,text:string,entity_type:string,confidence:double,source:string>"
SPANS_SQL = f"array<{SPAN_SQL}>"


def is_known(entity_type: str) -> bool:
    return entity_type in ENTITY_TYPES


def validate(entity_type: str) -> str:
    """The type itself, if it is in the registry."""
    if not is_known(entity_type):
        raise ValueError(f"unknown entity type {entity_type!r}")
    return entity_type


def rank_of(entity_type: str) -> int:
    return next((rank for rank, names in SPECIFICITY.items() if entity_type in names), OTHER_RANK)
