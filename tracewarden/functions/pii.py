"""Personal-data detectors: SSN, e-mail, phone, payment card."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import rules
from .text import extract_all, java_pattern

# A match can only start at one of these characters; the look-ahead rejects
# every other position before the boundary and the optional groups are tried.
_SSN = r"(?=\d)" + java_pattern(rules.SSN_PATTERN)
# A local part is read once and never given back: from the first word character of
# its run, or from where the last match ended, which the rule's boundary allows too.
_LOCAL, _DOMAIN = rules.EMAIL_PATTERN.removeprefix(r"\b").split("+@")
_EMAIL = (
    rf"(?:\G(?<=\w)(?!\w)|(?<!{_LOCAL})[.%+-]*+(?=\w))({_LOCAL}++@" + java_pattern(_DOMAIN) + ")"
)
_PHONE = r"(?=[+(\d])" + java_pattern(rules.PHONE_PATTERN)
_CARD = r"(?=\d)" + java_pattern(rules.CARD_PATTERN)

_HAS_DIGITS = r"[0-9]{4}"
_MATCH = "struct<type:string,value:string>"


def _where(condition: Column, text: Column, regex: str, group: int = 0) -> Column:
    empty = F.array().cast("array<string>")
    return F.coalesce(F.when(condition, extract_all(text, regex, group)), empty)


def detect_ssn(text: Column) -> Column:
    return _where(text.rlike(_HAS_DIGITS), text, _SSN)


def detect_email(text: Column) -> Column:
    return _where(F.contains(text, F.lit("@")), text, _EMAIL, 1)


def detect_phone(text: Column) -> Column:
    return _where(text.rlike(_HAS_DIGITS), text, _PHONE)


def card_candidates(text: Column) -> Column:
    return _where(text.rlike(r"[0-9]"), text, _CARD)


def luhn_valid(value: Column) -> Column:
    """Digits only, 13 to 19 of them, mod-10 sum over doubled second digits."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    weighted = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(
            i % 2 == 1, F.element_at(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), d.cast("int") + 1)
        ).otherwise(d.cast("int")),
    )
    total = F.aggregate(weighted, F.lit(0), lambda a, d: a + d)
    right_length = F.length(digits).between(rules.CARD_MIN_DIGITS, rules.CARD_MAX_DIGITS)
    return F.coalesce(F.when(right_length, total % 10 == 0), F.lit(False))


def detect_card(text: Column) -> Column:
    return F.filter(card_candidates(text), luhn_valid)


def detect_pii(text: Column) -> Column:
    """All matches as ``array<struct<type, value>>``, in detector order."""
    def typed(kind: str, values: Column) -> Column:
        return F.transform(
            values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
        )

    found = [
        typed("pii_ssn", detect_ssn(text)),
        typed("pii_email", detect_email(text)),
        typed("pii_phone", detect_phone(text)),
        typed("pii_credit_card", detect_card(text)),
    ]
    return F.concat(*found).cast(f"array<{_MATCH}>")


def contains_pii(text: Column) -> Column:
    """Any match; the cheap tests come first and stop the rest."""
    digits = text.rlike(_HAS_DIGITS)
    hit = (
        (F.contains(text, F.lit("@")) & text.rlike(_EMAIL))
        | (digits & text.rlike(_SSN))
        | (digits & text.rlike(_PHONE))
        | F.exists(card_candidates(text), luhn_valid)
    )
    return F.coalesce(hit, F.lit(False))
